"""Seeded noise and augmentation.

Every draw is ``uniform(seed, key[, position])`` so a rerun, another cluster
size or the SQL oracle picks the same labels, words and letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.hashing import row_hash32, sub_uniform, uniform
from corpusflow.functions.text import nonspace_tokens
from corpusflow.operators.lookup import row_lookup


def flip_labels(df: DataFrame, label: str, key: str, p: float, num_labels: int, seed,
                out: str = "noisy_label") -> DataFrame:
    """Flip a ``p`` share of labels to a different class, uniformly."""
    u = uniform(seed, key)
    u2 = uniform(f"{seed}:2", key)
    shift = 1 + F.floor(u2 * (num_labels - 1))
    return df.withColumn(out, F.when(u < p, (F.col(label) + shift) % num_labels)
                         .otherwise(F.col(label)).cast("int"))


def drop_words(df: DataFrame, text: str, key: str, p: float, seed, out: str = "text_out") -> DataFrame:
    """Drop each whitespace token with probability ``p``.

    Token ``i`` of a row is dropped iff ``sub_uniform(h, i) < p`` where ``h``
    is the row's md5 hash: one digest per row, integer mixing per token.
    """
    toks = nonspace_tokens(F.col(text))
    x = df.withColumn("_h32", row_hash32(seed, key))
    kept = F.filter(toks, lambda w, i: sub_uniform(F.col("_h32"), i) >= p)
    return x.withColumn(out, F.array_join(kept, " ")).drop("_h32")


def typos(df: DataFrame, text: str, key: str, p: float, seed, out: str = "text_out") -> DataFrame:
    """In a ``p`` share of tokens (length >= 2) swap two adjacent characters.

    Gate ``sub_uniform(h, i) < p`` with ``h`` the row hash for ``seed``; the
    swap position ``j = floor(sub_uniform(h2, i) * (len - 1))`` (0-based) with
    ``h2`` the row hash for ``seed:pos``.
    """
    toks = nonspace_tokens(F.col(text))
    x = df.withColumn("_h32", row_hash32(seed, key)).withColumn("_h32b", row_hash32(f"{seed}:pos", key))

    def swap(w, i):
        n = F.length(w)
        j = F.floor(sub_uniform(F.col("_h32b"), i) * (n - 1)).cast("int")
        swapped = F.concat(F.substring(w, 1, j), F.substring(w, j + 2, 1), F.substring(w, j + 1, 1),
                           F.substring(w, j + 3, 1 << 30))
        return F.when((sub_uniform(F.col("_h32"), i) < p) & (n >= 2), swapped).otherwise(w)

    return x.withColumn(out, F.array_join(F.transform(toks, swap), " ")).drop("_h32", "_h32b")


# marks that may stand around a token's word
MARKS = ".,;:!?*$%&#|()[]{}<>"


def _front(tok: Column) -> Column:
    return F.left(tok, F.length(tok) - F.length(F.ltrim(tok, F.lit(MARKS))))


def _back(tok: Column) -> Column:
    return F.right(tok, F.length(tok) - F.length(F.rtrim(tok, F.lit(MARKS))))


def replace_from_cache(df: DataFrame, text: str, key: str, cache: DataFrame, p: float, seed,
                       term: str = "term", repl: str = "replacement", out: str = "text_out") -> DataFrame:
    """Replace tokens found in a cache table with probability ``p``.

    A token is looked up by its word, lower-cased and without the marks around
    it, which stay, and only where the seeded draw picks it.  A cache within the
    byte bound is looked up inside the row (``row_lookup``).  Beyond it tokens
    are exploded and joined; those that are not picked have no word to look up
    and pass the join by.
    """
    look_up = row_lookup(cache, term, repl)
    if look_up is not None:
        def replace(tok: Column, i: Column) -> Column:
            new = F.concat(_front(tok), look_up(F.lower(F.btrim(tok, F.lit(MARKS)))), _back(tok))
            return F.when(sub_uniform(F.col("_h32"), i) < p, F.coalesce(new, tok)).otherwise(tok)

        x = df.select(key, row_hash32(seed, key).alias("_h32"), F.coalesce(nonspace_tokens(F.col(text)), F.array().cast("array<string>")).alias("_t"))
        return x.select(key, F.array_join(F.transform("_t", replace), " ").alias(out))
    ex = df.select(key, row_hash32(seed, key).alias("_h32"),
                   F.posexplode_outer(nonspace_tokens(F.col(text))).alias("pos", "tok"))
    picked = sub_uniform(F.col("_h32"), F.col("pos")) < p
    word = F.when(picked, F.lower(F.btrim("tok", F.lit(MARKS))))
    c = cache.select(F.col(term).alias("_term"), F.col(repl).alias("_r"))
    j = ex.withColumn("_term", word).join(c, "_term", "left")
    new = F.concat(_front(F.col("tok")), F.col("_r"), _back(F.col("tok")))
    j = j.withColumn("_w", F.when(F.col("_r").isNotNull(), new).otherwise(F.col("tok")))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(),
                                                                F.struct("pos", "_w")))).alias("_s"))
    return g.select(key, F.array_join(F.transform("_s", lambda s: s["_w"]), " ").alias(out))
