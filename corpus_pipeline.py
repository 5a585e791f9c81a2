"""A training-data pipeline over ``documents``: filter, clean, deduplicate, mix, tokenise.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``; the
last returns token ids.  Every stage works on all that its predecessor kept,
and takes nulls, empty texts, repeated rows, empty tables and further columns
as its operator does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import table
from corpusflow.llm.line_dedup import remove_boilerplate
from corpusflow.llm.mixing import mixed_documents
from corpusflow.llm.q_line_dedup import MIN_SITES
from corpusflow.llm.q_quality_cnn import KEEP
from corpusflow.llm.quality_cnn import fit, quality_score
from corpusflow.llm.sentencepiece_bpe import encode_decode
from corpusflow.llm.simhash import simhash_dedup
from corpusflow.session import scratch_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on ``labels``, predicts to be good text."""
    net = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_score(F.col("text"), net) >= KEEP)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources share (a line's first occurrence stays)."""
    return remove_boilerplate(docs, min_sites=MIN_SITES).select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash_dedup(docs, width=3, threshold=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for every copy, cut where a source's budget ends."""
    return mixed_documents(docs, weights=(5, 2, 1), share=1.5, max_epochs=2)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit, begin and end included) and the decoded text's length."""
    out = encode_decode(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"), digests=False)
    return docs.select("doc_id", out.alias("_out")).select(
        "doc_id", "_out.n_tokens", "_out.ids", F.char_length("_out.decoded").cast("bigint").alias("n_decoded_chars"))


STAGES = [("quality_classifier", quality_stage), ("line_dedup", line_stage), ("simhash_dedup", simhash_stage),
          ("mix_sources", mixing_stage), ("sentencepiece", token_stage)]

#: The network and the fingerprints have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
