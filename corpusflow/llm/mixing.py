"""Mixing sources to target weights: hash-random order, prefix sums, exact cuts.

Every row draws a hash key from its id and text, which fixes a random order
within its source.  The leading hex digits of the key range-partition a source
into equal buckets, so a source with a third of the corpus is spread over
``16**bucket_hex`` of them: bucket totals give each bucket's offset, and a
running sum inside a bucket gives each row's exact prefix sum.  A source's
budget is then cut at the word: whole epochs are repeated for every row, and
the rest goes to the first rows of the order, the last of them in part.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import cut, text_or_empty, word_count


def source_key(col: str) -> Column:
    """Sorts by code point with null last, and is never null itself."""
    return F.when(F.col(col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(col).cast("string")))


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """Water level over the source table (``_sk``, ``source_size``): adds ``target``.

    Targets are ``min(max_epochs * size, weight * level)`` where the level makes
    them add up to ``share`` of all sizes; that is where sharing by weight,
    capping and resharing the excess comes to rest.  With sources ordered by
    cap / weight the level is the largest of the per-source candidates.
    """
    by_name = Window.orderBy("_sk")
    t = totals.withColumn("_i", (F.row_number().over(by_name) - 1) % len(weights))
    t = t.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") + 1).cast("int")))
    t = t.withColumn("_cap", (F.col("source_size") * max_epochs).cast("bigint"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_sk")
    everything = Window.partitionBy()
    t = t.withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("_left", F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("_all", F.sum("source_size").over(everything))
    t = t.withColumn("_level", (F.lit(float(share)) * F.col("_all") - F.col("_before")) / F.col("_left"))
    t = t.withColumn("_level", F.max("_level").over(everything))
    return t.select("_sk", "source_size", F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_level")).alias("target"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                carry: Sequence[str] | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                max_epochs: int = 2, seed: int = 42, bucket_hex: int = 3) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``, default all columns),
    ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    A source's ``taken`` add up to its target rounded to a whole word.  Null and
    empty texts have size 0 and take nothing; a null source is a source of its
    own, last in order; rows with equal id and text are told apart only by
    position, so which of them takes more is arbitrary while the totals are
    not.  Null ids are ordered by their text.  Empty tables give empty results.
    Input columns sit inside ``row``, so their names cannot clash.
    """
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (carry if carry is not None else docs.columns)]).alias("row"),
        source_key(source).alias("_sk"),
        word_count(text).alias("size"),
        F.substring(F.md5(F.concat(F.lit(f"{seed}|"), ident, F.lit("|"), F.md5(text_or_empty(text).cast("binary"))).cast("binary")), 1, 16).alias("_h"),
    ).withColumn("_b", F.substring("_h", 1, bucket_hex))
    # one row per (source, bucket): at most 16**bucket_hex per source
    sums = cut(rows.groupBy("_sk", "_b").agg(F.sum("size").alias("_n")))
    targets = source_targets(sums.groupBy("_sk").agg(F.sum("_n").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("_sk").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(targets, "_sk")
    quota = F.round("target").cast("bigint")
    inside = Window.partitionBy("_sk", "_b").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, ["_sk", "_b"]).withColumn("_at", F.col("_off") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = quota - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("_at")))
    return out.select("row", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every copy that the mix takes.

    A row taken ``r`` times its size comes out ``ceil(r)`` times; where the
    budget cuts inside a row, that copy's text ends after its last taken word.
    Rows of which nothing is taken (empty ones included) go.
    """
    m = mix_sources(docs, text=text, **options).where(F.col("taken") > 0)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    m = m.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_copy") - 1) * F.col("size")).cast("int")
    # pieces of one word with the white space before it
    pieces = F.split(F.col("row")[text], r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut_text = F.when(words >= F.col("size"), F.col("row")[text]).otherwise(F.array_join(F.slice(pieces, 1, words), ""))
    out = m.withColumn("_text", cut_text)
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(F.col("_text").alias(c))
        elif c == n_chars:
            kind = docs.schema[c].dataType
            cols.append(F.when(words >= F.col("size"), F.col("row")[c]).otherwise(F.char_length("_text").cast(kind)).alias(c))
        else:
            cols.append(F.col("row")[c].alias(c))
    return out.select(*cols)
