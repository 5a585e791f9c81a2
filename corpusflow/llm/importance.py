"""Importance resampling towards a target text collection, by hashed n-grams.

Every n-gram of a corpus text falls into a bucket.  Bucket counts over the
whole corpus and over the target give each bucket a gain, the logarithm of how
much more frequent it is in the target; a document's weight is the mean gain of
its n-grams, and a Gumbel draw added to it turns the highest scores into a
sample without replacement by importance.

Texts are taken in batches: the n-grams of a batch are interned in an
open-addressed numpy table (``interning``), so the bucket of an n-gram is worked
out once for its slot, slots count their occurrences, and the slot ids of a
document's occurrences gather its gains.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.arrow import arrow_udf, on_workers, struct
from corpusflow.llm.common import cut
from corpusflow.llm.interning import PADDING, crc32, intern, runs, slices, text_buffer
from corpusflow.operators.ranks import global_rank

#: Bytes of text that share a table.
PART_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words after lower-casing: digits, small letters and all of characters beyond ASCII.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


class Grams(NamedTuple):
    """The n-grams of some texts: slot of each, text of each, words of each text, and for each slot its bucket."""

    slot: np.ndarray
    text: np.ndarray
    n_words: np.ndarray
    bucket: np.ndarray


def grams(texts: pa.Array, max_n: int, buckets: int) -> Grams:
    buf, offsets = text_buffer(texts)
    end = int(offsets[-1])
    buf[:end] = LOWER[buf[:end]]
    inside = IN_WORD[buf[:end]]
    starts, lengths = runs(inside, offsets)
    text = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(text, minlength=len(texts))
    if max_n > 1:  # words side by side, one space between them
        first = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int((lengths + 1).sum()) + PADDING, 32, dtype=np.uint8)
        word = np.repeat(np.arange(len(starts)), lengths)
        joined[np.arange(len(word)) + word] = buf[:end][inside]
        at, size, of = [first], [lengths], [text]
        for n in range(2, max_n + 1):
            some = np.flatnonzero(text[n - 1:] == text[:len(text) - n + 1])
            at.append(first[some])
            size.append(first[some + n - 1] + lengths[some + n - 1] - first[some])
            of.append(text[some])
        buf, starts, lengths, text = joined, np.concatenate(at), np.concatenate(size), np.concatenate(of)
    slot, standing = intern(buf, starts, lengths)
    return Grams(slot, text, n_words, crc32(buf, starts[standing], lengths[standing]) % buckets)


def bucket_counts(texts: DataFrame, text: str = "text", *, max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """``bucket`` and ``n``, the n-grams of all texts in it; at most ``buckets`` rows, and as many from a task."""
    on_workers()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for some in slices(batch.column("_text"), PART_BYTES):
                g = grams(some, max_n, buckets)
                np.add.at(total, g.bucket, np.bincount(g.slot, minlength=len(g.bucket)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    parts = texts.select(F.col(f"`{text}`").alias("_text")).mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text",
                 max_n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """The gain of every bucket: ``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` for ``s`` of all ``S`` n-grams of
    ``docs`` and ``t`` of all ``T`` of ``target`` in the bucket, of ``B`` buckets.

    Two numbers a bucket come to the driver, so their number is that of the buckets.
    """
    s = bucket_counts(docs, text, max_n=max_n, buckets=buckets).select("bucket", F.col("n").alias("s"))
    t = bucket_counts(target, target_text, max_n=max_n, buckets=buckets).select(F.col("bucket").alias("_b"), F.col("n").alias("t"))
    both = s.join(t, F.col("bucket") == F.col("_b"), "full").select(
        F.coalesce("bucket", "_b").alias("bucket"), F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    counts = np.zeros((2, buckets))
    for r in both.collect():
        counts[:, r["bucket"]] = r["s"], r["t"]
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def importance_weight(text: Column, gains: np.ndarray, *, max_n: int = 1) -> Column:
    """A struct of ``n_words``, ``n_features`` and ``weight``, the floored mean gain (0 where there is no n-gram)."""
    buckets = len(gains)

    @arrow_udf("struct<n_words: long, n_features: long, weight: long>")
    def weigh(texts: pa.Array) -> pa.Array:
        words, features, weights = [], [], []
        for some in slices(texts, PART_BYTES):
            g = grams(some, max_n, buckets)
            n = np.bincount(g.text, minlength=len(some))
            upto = np.concatenate(([0], np.cumsum(gains[g.bucket][g.slot][np.argsort(g.text, kind="stable")])))
            ends = np.cumsum(n)
            words.append(g.n_words)
            features.append(n)
            weights.append((upto[ends] - upto[ends - n]) // np.maximum(n, 1))
        one = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, features, weights)]
        return struct(dict(zip(("n_words", "n_features", "weight"), (pa.array(x, pa.int64()) for x in one))))

    return weigh(text)


def gumbel(key: Column, seed: int) -> Column:
    """``floor(-1000 ln(-ln((h + 0.5) / 2^32)))``, where h is the first 32 bits of sha256 of ``<seed>:<key>``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             max_n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the N documents of ``min_words`` words or more, the ``floor(percent * N / 100)`` highest scores are drawn and
    ranked from 1; ties go to the smaller id, null ids last.  ``rank`` is null for all others.  Null and empty texts
    have no n-gram and weight 0.  Repeated rows are ranked one after another.  An empty table gives an empty result,
    an empty target the gains of a target without any n-gram.  Other columns of ``docs`` play no part.
    """
    gains = bucket_gains(docs, target, text=text, target_text=target_text, max_n=max_n, buckets=buckets)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), importance_weight(F.col(f"`{text}`"), gains, max_n=max_n).alias("_w"))
    rows = rows.select("doc_id", "_w.*").withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = cut(rows)
    eligible = F.col("n_words") >= min_words
    draw = percent * rows.where(eligible).count() // 100
    # rows that are equal in all of this differ by their place in the written table
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    ranked = global_rank(rows.where(eligible).withColumn("_place", F.monotonically_increasing_id()), order, "_place",
                         materialize_input=False).drop("_place")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return ranked.unionByName(rows.where(~eligible).withColumn("rank", F.lit(None).cast("bigint")))
