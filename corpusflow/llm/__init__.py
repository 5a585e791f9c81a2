"""Operators of a training-data pipeline (near-dedup, mixing, tokenising, filtering).

Nothing else in the library imports this subpackage; ``queries`` registers one
query per operator.
"""
