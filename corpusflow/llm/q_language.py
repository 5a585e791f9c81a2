"""op7: language of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.llm.common import held_out, table
from corpusflow.llm.language import fit, identify
from corpusflow.llm.registry import query


@query("op7_language_centroids")
def op7_language_centroids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return docs.select("doc_id", held_out().alias("held_out"), identify(F.col("text"), model, reject=False).alias("_out")).select(
        "doc_id", "held_out", "_out.*")
