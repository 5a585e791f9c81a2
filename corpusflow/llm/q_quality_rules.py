"""op9: repetition rules over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.llm.common import table
from corpusflow.llm.quality_rules import repetition_rules
from corpusflow.llm.registry import query


@query("op9_repetition_rules")
def op9_repetition_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", repetition_rules(F.col("text")).alias("_out")).select("doc_id", "_out.*")
