"""Profiles, group statistics, ordered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_distribution(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows per (split, label) and the label's share of its split (G1)."""
    c = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n_rows"))
    # the grouped table has splits x labels rows: a per-split window over it is tiny
    return c.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(split)))


def group_mean(df: DataFrame, by, cols: list[str]) -> DataFrame:
    """Mean of each column per group."""
    return df.groupBy(by).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def group_mean_std(df: DataFrame, by, cols: list[str]) -> DataFrame:
    """Rows, and mean and sample std (ddof=1; one row -> null) of many metrics."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return df.groupBy(by).agg(*aggs)


def summary_stats_pop(df: DataFrame, col: str) -> DataFrame:
    """Global min / max / mean / population std (G4, numpy ddof=0)."""
    return df.agg(F.count(col).alias("n"), F.min(col).alias("min_v"), F.max(col).alias("max_v"),
                  F.avg(col).alias("mean_v"), F.stddev_pop(col).alias("std_v"))


def array_stats(arr: Column) -> dict[str, Column]:
    """Mean, mean of |x| and unbiased std of a numeric array, per row."""
    x = F.transform(arr, lambda v: v.cast("double"))
    n = F.size(x)
    s = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    sa = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v))
    mean = s / n
    ss = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    std = F.when(n > 1, F.sqrt(ss / (n - 1)))
    return {"mean": mean, "abs_mean": sa / n, "std": std}


def layer_group_key(name: Column, sep: str = ".") -> Column:
    """First all-digit dotted part ``d`` -> ``layer_d`` plus ``_<next part>`` if any.

    Names without an all-digit part give null (and are dropped by the caller).
    """
    import re
    parts = F.split(name, re.escape(sep))
    idx = F.array_position(F.transform(parts, lambda p: p.rlike(r"^[0-9]+$")), True)
    digit = F.element_at(parts, idx.cast("int"))
    nxt = F.when(idx < F.size(parts), F.concat(F.lit("_"), F.element_at(parts, (idx + 1).cast("int")))).otherwise(F.lit(""))
    return F.when(idx > 0, F.concat(F.lit("layer_"), digit, nxt))


def path_group_mean(df: DataFrame, name: str, score: str, out: str = "group_key",
                    sep: str = ".") -> DataFrame:
    """Group mean by the layer key of a dotted path; names with no key dropped."""
    k = df.withColumn(out, layer_group_key(F.col(name), sep)).where(F.col(out).isNotNull())
    return k.groupBy(out).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n_items"))


def group_by_value(df: DataFrame, value: str, name: str) -> DataFrame:
    """Invert a map: names grouped by value, sorted."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n_names"),
                                 F.sort_array(F.collect_list(name)).alias("names"))


def median_int(df: DataFrame, by, col: str) -> DataFrame:
    """Exact interpolated median, truncated to int.

    Computed from the value histogram per group: counts per (group, value)
    are a partial + final aggregate, a running count over the histogram
    locates the two middle values (0-based positions floor((N-1)/2) and
    ceil((N-1)/2)), and the median is their mean.  A group holding a third of
    the rows costs as many histogram entries as it has distinct values, not
    rows.  Nulls are ignored, as ``percentile`` does.
    """
    by = [by] if isinstance(by, str) else list(by)
    # null values stay as a zero-weight entry, so an all-null group still
    # yields a (null) row, like percentile
    h = (df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
           .withColumn("_c", F.when(F.col(col).isNotNull(), F.col("_c")).otherwise(0)))
    w = Window.partitionBy(*by).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_cum", F.sum("_c").over(w)).withColumn("_N", F.sum("_c").over(Window.partitionBy(*by)))
    lo = F.floor((F.col("_N") - 1) / 2)
    hi = F.ceil((F.col("_N") - 1) / 2)
    ok = F.col(col).isNotNull()
    g = h.groupBy(*by).agg(F.min(F.when(ok & (F.col("_cum") > lo), F.col(col))).alias("_lo"),
                          F.min(F.when(ok & (F.col("_cum") > hi), F.col(col))).alias("_hi"))
    return g.select(*by, ((F.col("_lo") + F.col("_hi")) / 2).cast("int").alias("median_int"))


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """Top-k by score descending, ties by ``tie`` (W1); the limit is the feature."""
    return df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)


def best_per_group(df: DataFrame, by, metric: str, tie: str) -> DataFrame:
    """Row with the greatest metric per group, tie -> smallest ``tie``.

    ``max_by`` over a struct is a partial aggregate: each map task keeps only
    its best row per group, so no group is collected.
    """
    order = F.struct(F.col(metric), (-F.col(tie)).alias("_neg"))
    other = [c for c in df.columns if c not in ([by] if isinstance(by, str) else list(by))]
    best = df.groupBy(by).agg(F.max_by(F.struct(*other), order).alias("_best"))
    return best.select(*([by] if isinstance(by, str) else list(by)), "_best.*")
