"""Line dedup by distinct-site spread: sketches first, exact counts near the threshold.

A HyperLogLog sketch of sites per line hash merges map-side and across the
shuffle, so a line that stands in a third of the corpus is one small sketch per
task.  Sketch estimates settle the lines far from the threshold; lines whose
estimate falls inside the sketch's error band get an exact distinct count.
Lines on at least ``min_sites`` sites are boilerplate: their first occurrence
(smallest document, then position) stays, every other one goes.  Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import cut, row_digest, stored, text_or_empty
from corpusflow.operators.ranks import bounded_broadcast

#: Bits of the HyperLogLog index; the relative standard error is 1.04 / sqrt(2**LG_K).
LG_K = 8


def site_lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """Lines with at least one word: row digest, position, line hash (96 bits), site."""
    rows = docs.select(*row_digest(doc_id, text), F.col(doc_id).cast("bigint").alias("_id"),
                       F.col(site).cast("string").alias("_site"), F.posexplode(F.split(text_or_empty(text), "\n", -1)).alias("_pos", "_line"))
    return rows.where(F.col("_line").rlike(r"[^\x20\x09-\x0D]")).select(
        "_d1", "_d2", "_id", "_site", "_pos", F.xxhash64("_line").alias("_h1"), F.hash("_line").alias("_h2"))


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """(_h1, _h2) of the lines that stand on at least ``min_sites`` distinct sites; null is no site."""
    band = 4 * 1.04 / 2 ** (lg_k / 2)
    sketches = lines.where(F.col("_site").isNotNull()).groupBy("_h1", "_h2").agg(
        F.hll_sketch_agg(F.xxhash64("_site"), F.lit(lg_k)).alias("_sketch"))
    spread = cut(sketches.select("_h1", "_h2", F.hll_sketch_estimate("_sketch").alias("_est"))
                 .where(F.col("_est") >= min_sites * (1 - band)))
    sure = spread.where(F.col("_est") > min_sites * (1 + band)).select("_h1", "_h2")
    near = bounded_broadcast(spread.where(F.col("_est") <= min_sites * (1 + band)).select("_h1", "_h2"))
    exact = (lines.where(F.col("_site").isNotNull()).join(near, ["_h1", "_h2"]).select("_h1", "_h2", "_site").distinct()
             .groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_sites).select("_h1", "_h2"))
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, *, min_sites: int = 10, doc_id: str = "doc_id", text: str = "text",
                       site: str = "source", n_chars: str | None = "n_chars", lg_k: int = LG_K) -> DataFrame:
    """``row`` (struct of the input columns, text and ``n_chars`` renewed), ``n_lines`` and ``n_removed``.

    Every input row comes back.  Lines are split at ``\\n`` and compared as they
    stand; lines without a word are never removed.  Null texts stay null, with
    no lines.  A null site adds nothing to a line's spread, yet its lines are
    removed like others.  Rows with equal id and text keep or lose the same
    lines; a null id counts as smaller than any other.
    """
    lines = stored(site_lines(docs, doc_id, text, site), "lines")  # narrow; the texts are read once here and once below
    # sent to the lines where its checked size allows; beyond it AQE splits the frequent lines of the join
    hits = cut(lines.join(bounded_broadcast(boilerplate_lines(lines, min_sites, lg_k)), ["_h1", "_h2"])
               .select("_h1", "_h2", F.struct("_id", "_d1", "_d2", "_pos").alias("_at")))
    first = bounded_broadcast(hits.groupBy("_h1", "_h2").agg(F.min("_at").alias("_first")))
    gone = (hits.join(first, ["_h1", "_h2"]).where(F.col("_at") != F.col("_first"))
            .groupBy(F.col("_at._d1").alias("_d1"), F.col("_at._d2").alias("_d2"))
            .agg(F.collect_set("_at._pos").alias("_gone")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_digest(doc_id, text))
    rows = rows.join(gone, ["_d1", "_d2"], "left")
    parts = F.split(F.col("_row")[text], "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    rows = rows.withColumn("_text", F.when(F.col("_gone").isNull(), F.col("_row")[text]).otherwise(kept))
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(F.col("_text").alias(c))
        elif c == n_chars:
            kind = docs.schema[c].dataType
            cols.append(F.when(F.col("_gone").isNull(), F.col("_row")[c]).otherwise(F.char_length("_text").cast(kind)).alias(c))
        else:
            cols.append(F.col("_row")[c].alias(c))
    n_lines = F.coalesce(F.size(parts).cast("bigint"), F.lit(0))
    return rows.select(F.struct(*cols).alias("row"),
                       F.when(F.col("_row")[text].isNull(), F.lit(0).cast("bigint")).otherwise(n_lines).alias("n_lines"),
                       F.coalesce(F.size("_gone").cast("bigint"), F.lit(0)).alias("_n")).select(
        "row", "n_lines", F.greatest("_n", F.lit(0).cast("bigint")).alias("n_removed"))
