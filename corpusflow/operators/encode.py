"""Vocabulary, fixed-length encoding, length profiles.

The sub-word tokenizer of the reference is replaced by a word vocabulary
built from the corpus: ids 0 = pad, 1 = unknown, 2.. by (count desc, term).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import n_words, words
from corpusflow.operators.lookup import row_lookup
from corpusflow.operators.ranks import bounded_broadcast

PAD, UNK = 0, 1


def build_vocab(df: DataFrame, text: str, size: int) -> DataFrame:
    """Top ``size`` words by (count desc, term) with ids from 2.

    Counting is a partial+final hash aggregate; the top-``size`` cut is the
    feature and bounds the vocabulary, which is what makes it safe to
    broadcast in ``encode``.
    """
    counts = (df.select(F.explode_outer(words(F.col(text))).alias("term")).where(F.col("term").isNotNull())
                .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    top = counts.orderBy(F.col("n").desc(), F.col("term")).limit(size)
    # <= size rows after the limit: this window is bounded by the parameter
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("term"))) + 1).cast("int"))


def token_ids(df: DataFrame, key: str, text: str, vocab: DataFrame, max_length: int | None) -> DataFrame:
    """``(key, pos, term, token_id)`` for the first ``max_length`` words (all when None).

    The vocabulary is bounded by its ``size`` parameter, so it is broadcast;
    the long side is never shuffled for the lookup.
    """
    w = words(F.col(text))
    if max_length is not None:
        w = F.slice(w, 1, max_length)
    # posexplode_outer keeps rows without tokens as one (null, null) row
    ex = df.select(key, F.posexplode_outer(w).alias("pos", "term"))
    v = F.broadcast(vocab.select("term", F.col("id").alias("_vid")))
    return ex.join(v, "term", "left").select(
        key, "pos", "term", F.when(F.col("pos").isNotNull(), F.coalesce("_vid", F.lit(UNK))).alias("token_id"))


def encode_ragged(df: DataFrame, key: str, text: str, vocab: DataFrame, max_length: int | None) -> DataFrame:
    """``key``, ``ids`` of the first ``max_length`` words (all when None) and their number ``n_tokens``.

    A vocabulary within the byte bound is a constant of the plan, and each row looks its own words up
    (``row_lookup``); a larger one is joined to the exploded words, and the regroup by ``key`` is
    partial-aggregated in the task that exploded the row.
    """
    look_up = row_lookup(vocab, "term", "id")
    if look_up is not None:
        w = words(F.col(text)) if max_length is None else F.slice(words(F.col(text)), 1, max_length)
        ids = F.transform(F.coalesce(w, F.array().cast("array<string>")), lambda t: F.coalesce(look_up(t), F.lit(UNK)))
        return df.select(key, ids.alias("ids")).select(key, "ids", F.size("ids").alias("n_tokens"))
    ids = token_ids(df, key, text, vocab, max_length)
    tok = F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id"))
    g = ids.groupBy(key).agg(F.array_sort(F.collect_list(tok)).alias("_s"))
    return g.select(key, F.transform("_s", lambda s: s["token_id"]).alias("ids"), F.size("_s").alias("n_tokens"))


def padded(ids: str, n: str, length: Column) -> list[Column]:
    """``input_ids`` and ``attention_mask`` of ``length``: right-padded with 0, the mask 1 for real tokens."""
    pad = F.array_repeat(F.lit(PAD), length - F.col(n))
    return [F.concat(ids, pad).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.col(n)), pad).alias("attention_mask")]


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame, max_length: int) -> DataFrame:
    """Text -> ``input_ids``/``attention_mask`` of exactly ``max_length`` and ``n_tokens``."""
    return encode_ragged(df, key, text, vocab, max_length).select(key, *padded("ids", "n_tokens", F.lit(max_length)), "n_tokens")


def length_profile(df: DataFrame, by, text: str, max_length: int) -> DataFrame:
    """Mean tokens and share truncated at ``max_length``."""
    return (df.withColumn("_n", n_words(F.col(text))).groupBy(by)
              .agg(F.count(F.lit(1)).alias("n_docs"), F.avg("_n").alias("mean_tokens"),
                   F.avg(F.when(F.col("_n") > max_length, 1.0).otherwise(0.0)).alias("truncated_share")))


def oov_ratio(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """Share of tokens outside the vocabulary per row (T10); no tokens -> null."""
    ids = encode_ragged(df, key, text, vocab, None)
    unknown = F.size(F.filter("ids", lambda t: t == UNK))
    return ids.select(key, F.try_divide(unknown.cast("double"), F.col("n_tokens")).alias("oov_ratio"))


def pad_to_batch_max(encoded: DataFrame, batch: str, n_tokens: str = "n_tokens") -> DataFrame:
    """Dynamic padding per batch (T17): padded length = the batch's longest
    row; waste = padding share of the padded batch."""
    return (encoded.groupBy(batch)
                   .agg(F.count(F.lit(1)).alias("n_rows"), F.max(n_tokens).alias("padded_len"),
                        F.sum(n_tokens).alias("_real"))
                   .withColumn("waste_share", F.when(F.col("padded_len") > 0,
                               1 - F.col("_real") / (F.col("padded_len") * F.col("n_rows"))))
                   .drop("_real"))


def pad_batches(encoded: DataFrame, batch: str, ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """The rows of ``encoded`` padded to the longest row of their batch (T17), as a collator gives them to a model:
    ``ids`` gives way to ``input_ids``, ``attention_mask`` and ``padded_len``.

    The batches' lengths are a table of their own, written once; rows meet it by a broadcast where its size has been
    checked, else by a join on the batch.  A batch without a token has length 0.  Null batches are a batch.
    """
    longest = bounded_broadcast(encoded.groupBy(F.col(batch).alias("_batch")).agg(F.max(n_tokens).alias("padded_len")))
    j = encoded.join(longest, F.col(batch).eqNullSafe(F.col("_batch")))
    return j.select(*[c for c in encoded.columns if c != ids], *padded(ids, n_tokens, F.col("padded_len")), "padded_len")
