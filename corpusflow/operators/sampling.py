"""Sampling and splitting (exact, seeded, reproducible across engines).

All choices are driven by ``md5(seed|key)``: the same seed picks the same rows
on any cluster size, any partitioning, and in the DuckDB oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.hashing import hash_order, uniform
from corpusflow.operators.ranks import class_rank, stratified_quota, within_rank_limits

SPLITS = ("train", "validation", "test")


def sample_exact(df: DataFrame, n: int, seed: int, key: str, out: str = "rank") -> DataFrame:
    """Uniform sample without replacement of ``min(n, rows)`` rows (A1)."""
    return class_rank(df, [], hash_order(seed, key), key, out=out, max_rank=n)


def few_shot(df: DataFrame, n: int, label: str, seed: int, key: str,
             split_col: str | None = None, out: str = "rank") -> DataFrame:
    """``min(n, class size)`` rows per class (A2).

    With ``split_col`` only the ``train`` rows are sampled; rows of the other
    splits pass through unchanged (their ``out`` is null).
    """
    if split_col is None:
        return class_rank(df, [label], hash_order(seed, key), key, out=out, max_rank=n)
    train = df.where(F.col(split_col) == "train")
    rest = df.where(~(F.col(split_col) == "train") | F.col(split_col).isNull()).withColumn(out, F.lit(None).cast("bigint"))
    return class_rank(train, [label], hash_order(seed, key), key, out=out, max_rank=n).unionByName(rest)


def reduction(original: DataFrame, sampled: DataFrame) -> DataFrame:
    """Original rows, sampled rows and their ratio (A3); one row."""
    o = original.agg(F.count(F.lit(1)).alias("orig_rows"))
    s = sampled.agg(F.count(F.lit(1)).alias("sampled_rows"))
    return o.crossJoin(F.broadcast(s)).withColumn(
        "reduction", F.when(F.col("sampled_rows") > 0, F.col("orig_rows") / F.col("sampled_rows")))


def stratified_split(df: DataFrame, label: str, frac: float, seed: int, key: str,
                     held: str = "test", kept: str = "train", out: str = "split") -> DataFrame:
    """Stratified two-way split (A4): ``frac`` of every class goes to ``held``.

    Only "seeded rank <= quota" is needed: ``within_rank_limits`` derives the
    quotas from its bucket sizes, decides whole hash buckets at once and ranks
    only the boundary rows."""
    def quotas(counts):
        return stratified_quota(counts, label, "_c", frac).select(label, F.col("quota").alias("_q"))

    r = within_rank_limits(df, [label], hash_order(seed, key), key, quotas)
    return r.withColumn(out, F.when(F.col("_le_0"), F.lit(held)).otherwise(F.lit(kept))).drop("_le_0")


def stratified_split3(df: DataFrame, label: str, val: float, test: float, seed: int,
                      key: str, out: str = "split") -> DataFrame:
    """Stratified three-way split (A5).

    Stage 1 holds out ``val+test`` of every class; stage 2 splits the held
    rows, giving ``test`` a ``1 - val/(val+test)`` share.  Both stages use the
    same seeded order, so one rank serves both: rank <= q2 is test,
    q2 < rank <= q1 is validation, the rest is train.
    """
    def quotas(counts):
        q1 = stratified_quota(counts, label, "_c", val + test).select(label, F.col("quota").alias("_q1"))
        q2 = stratified_quota(q1.select(label, F.col("_q1").alias("_c")), label, "_c",
                              1 - val / (val + test)).select(F.col(label).alias("_k2"), F.col("quota").alias("_q2"))
        return q1.join(q2, F.col(label).eqNullSafe(F.col("_k2"))).drop("_k2")

    r = within_rank_limits(df, [label], hash_order(seed, key), key, quotas)
    s = (F.when(F.col("_le_1"), F.lit("test"))
          .when(F.col("_le_0"), F.lit("validation"))
          .otherwise(F.lit("train")))
    return r.withColumn(out, s).drop("_le_0", "_le_1")


def ensure_splits(df: DataFrame, label: str, val: float, test: float, seed: int, key: str,
                  split_col: str = "split") -> DataFrame:
    """Create the missing splits from ``train``.

    All three present: unchanged.  No train: error.  Only validation or only
    test missing: a stratified two-way split of train.  Both missing: A5.
    The presence check reads the distinct split values (at most a handful).
    """
    present = {r[0] for r in df.select(split_col).distinct().collect() if r[0] is not None}
    if all(s in present for s in SPLITS):
        return df
    if "train" not in present:
        raise ValueError("Dataset must have at least a 'train' split")
    train = df.where(F.col(split_col) == "train").drop(split_col)
    rest = df.where(~F.col(split_col).eqNullSafe("train"))  # rows without a split stay as they are
    if "validation" not in present and "test" not in present:
        made = stratified_split3(train, label, val, test, seed, key, out=split_col)
    elif "validation" not in present:
        made = stratified_split(train, label, val, seed, key, held="validation", out=split_col)
    else:
        made = stratified_split(train, label, test, seed, key, held="test", out=split_col)
    return made.unionByName(rest.select(*made.columns))


#: Largest rate that one draw serves; a larger one is the sum of independent draws.
MAX_RATE = 16.0


def poisson_cdf(lam: float) -> list[float]:
    """Cumulative Poisson(lam) probabilities P(X <= k) for k = 0, 1, ..., until
    the tail is below the resolution of a 32-bit uniform draw."""
    out, p, acc, k = [], math.exp(-lam), 0.0, 0
    while 1 - acc > 2.0 ** -33 or k <= lam:
        acc += p
        out.append(acc)
        k += 1
        p *= lam / k
        if p < 1e-18 and k > lam:
            break
    return out


def poisson_draw(lam: float, seed, key: str) -> Column:
    """Poisson(lam) count per row: the inverse CDF of a seeded uniform, or the
    sum of several independent ones where the rate is large."""
    n = max(1, math.ceil(lam / MAX_RATE))
    cdf = poisson_cdf(lam / n)
    total = None
    for i in range(n):
        u = uniform(seed if i == 0 else f"{seed}:part{i}", key)
        k = F.size(F.filter(F.array(*[F.lit(c) for c in cdf]), lambda c: c <= u))
        total = k if total is None else total + k
    return total


def bootstrap(df: DataFrame, frac: float, seed: int, key: str, out: str = "replica") -> DataFrame:
    """Poisson bootstrap (A7): each row appears ``Poisson(frac)`` times.

    The count is the inverse CDF of a seeded uniform, so the sample is
    reproducible and needs no shuffle; rows are replicated with
    ``explode(sequence)``.  Expected size ``frac * rows``, drawn with
    replacement.
    """
    return (df.withColumn("_k", poisson_draw(frac, seed, key)).where(F.col("_k") > 0)
              .withColumn(out, F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k"))


def sample_with_replacement(df: DataFrame, n: int, seed: int, key: str, out: str = "times") -> DataFrame:
    """Exactly ``n`` draws with replacement (A7): the rows drawn, each with how often.

    Draw d hits the row at position ``floor(u_d * N)`` of the seeded order, where u_d has 52 bits of
    ``md5(seed|draw|d)``, so neither the number of draws nor the rows depend on partitioning.  Positions are exact
    ranks over hash buckets (``class_rank``): the draws fall on buckets in proportion to their rows, a multinomial
    split of ``n``, and on the rows inside one alike.  Draws are counted per position before they meet the rows.
    A table without rows gives none.
    """
    total = df.count()
    u = F.conv(F.substring(hash_order(seed, F.lit("draw"), "id"), 1, 13), 16, 10).cast("bigint") / F.lit(2.0 ** 52)
    at = F.least(F.floor(u * F.lit(float(total))).cast("bigint"), F.lit(total - 1)) + 1
    draws = df.sparkSession.range(n).select(at.alias("_at")).groupBy("_at").agg(F.count(F.lit(1)).alias(out))
    ranked = class_rank(df, [], hash_order(seed, key), key, out="_at")
    return ranked.join(draws, "_at").drop("_at")


def few_shot_curve(df: DataFrame, shots: list[int], label: str, seed: int, key: str,
                   out_n: str = "n_shots") -> DataFrame:
    """Nested few-shot sets for every n in ``shots`` (A8): rank once, join the shot list."""
    spark = df.sparkSession
    r = class_rank(df, [label], hash_order(seed, key), key, out="rank", max_rank=max(shots))
    s = spark.createDataFrame([(int(n),) for n in shots], f"{out_n} int")
    return r.join(F.broadcast(s), F.col("rank") <= F.col(out_n))


def replicate(df: DataFrame, seeds: list[int], n: int, label: str, key: str,
              seed_col: str = "seed") -> DataFrame:
    """Few-shot sample repeated for several seeds (A9), ranked per (seed, label)."""
    spark = df.sparkSession
    s = spark.createDataFrame([(int(x),) for x in seeds], f"{seed_col} int")
    x = df.crossJoin(F.broadcast(s))
    order = F.md5(F.concat(F.col(seed_col).cast("string"), F.lit("|"), F.col(key).cast("string")))
    return class_rank(x, [seed_col, label], order, key, out="rank", max_rank=n)


def assign_batches(df: DataFrame, batch_size: int, seed: int, key: str,
                   out: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``batch_size`` in seeded sample order (A10)."""
    r = class_rank(df, [], hash_order(seed, key), key, out="sample_rank")
    return r.withColumn(out, F.floor((F.col("sample_rank") - 1) / batch_size).cast("bigint"))


def select_split(df: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    """``all`` = every split, else one (P16).  A split that is not present is
    an error naming the available ones (the check reads the distinct split
    values, at most a handful)."""
    if split == "all":
        return df
    avail = sorted(r[0] for r in df.select(split_col).distinct().collect() if r[0] is not None)
    if split not in avail:
        raise ValueError(f"Split {split!r} not found. Available: {avail}")
    return df.where(F.col(split_col) == split)
