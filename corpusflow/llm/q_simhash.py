"""op2: SimHash groups of all documents (3-word shingles, 3 bits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.llm.common import table
from corpusflow.llm.registry import query
from corpusflow.llm.simhash import simhash_groups


@query("op2_simhash_groups")
def op2_simhash_groups(spark, sf_dir):
    g = simhash_groups(table(spark, sf_dir, "documents"), width=3, threshold=3)
    return g.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
