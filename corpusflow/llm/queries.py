"""All queries of the subpackage; importing this module registers them."""

from corpusflow.llm.registry import ORACLE, QUERIES  # noqa: F401
from corpusflow.llm import q_bin_packing, q_importance, q_language, q_license_scan, q_line_dedup, q_mixing, q_nn_descent, q_prefix_trie, q_quality_cnn, q_quality_rules, q_sentencepiece, q_simhash, q_token_output  # noqa: F401
