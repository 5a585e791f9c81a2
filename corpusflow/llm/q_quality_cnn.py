"""op6: quality of all documents by the byte-level network."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.llm.common import held_out, table
from corpusflow.llm.quality_cnn import fit, quality_score
from corpusflow.llm.registry import query

#: Scores from here on are predicted to be good text.
KEEP = 0.3


@query("op6_quality_network")
def op6_quality_network(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))
