"""Experiment analytics over summary tables.

Inputs are flat run tables (one row per run: experiment, method, metrics).
Every operator is a grouped aggregate or a join on run keys; the tables are
as large as the number of runs, which grows with the data they summarise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.schema import extract_int

# Two-sided 5 % critical values of Student's t by degrees of freedom
T_CRIT_05 = [
    (1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (6, 2.447), (7, 2.365), (8, 2.306),
    (9, 2.262), (10, 2.228), (11, 2.201), (12, 2.179), (13, 2.160), (14, 2.145), (15, 2.131),
    (16, 2.120), (17, 2.110), (18, 2.101), (19, 2.093), (20, 2.086), (21, 2.080), (22, 2.074),
    (23, 2.069), (24, 2.064), (25, 2.060), (26, 2.056), (27, 2.052), (28, 2.048), (29, 2.045),
    (30, 2.042),
]
# the normal quantile that they approach
Z_CRIT_05 = 1.959964


def t_critical(df: Column) -> Column:
    """Critical value for ``df`` degrees of freedom: the fixed table up to 30,
    beyond it the expansion around the normal quantile (right to 3 decimals)."""
    table = F.array(*[F.lit(v) for _, v in T_CRIT_05])
    z = Z_CRIT_05
    far = F.lit(z) + F.lit((z ** 3 + z) / 4) / df + F.lit((5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96) / (df.cast("double") * df)
    return F.when(df.between(1, 30), F.element_at(table, df.cast("int"))).when(df > 30, F.round(far, 3))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom: the finite
    trigonometric sum of its distribution, term by term."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    sin, cos = F.sin(theta), F.cos(theta)
    odd = df % 2 == 1
    # odd: cos, then * cos^2 * 2j/(2j+1); even: 1, then * cos^2 * (2j-1)/(2j)
    more = F.when(odd, F.floor((df - 3) / 2)).otherwise(F.floor((df - 2) / 2)).cast("int")
    steps = F.when(more >= 1, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))
    first = F.when(odd, F.when(df >= 3, cos).otherwise(F.lit(0.0))).otherwise(F.lit(1.0))
    total = F.aggregate(
        steps, F.struct(first.alias("sum"), first.alias("term")),
        lambda a, j: F.struct((a["sum"] + a["term"] * cos * cos * F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))).alias("sum"),
                              (a["term"] * cos * cos * F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))).alias("term")),
        lambda a: a["sum"])
    inside = F.when(odd, F.lit(2 / math.pi) * (theta + sin * total)).otherwise(sin * total)
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))


def single_task(summary: DataFrame, exp: str = "experiment") -> DataFrame:
    return summary.where(~F.col(exp).contains("shot"))


def few_shot_runs(summary: DataFrame, exp: str = "experiment") -> DataFrame:
    return (summary.where(F.col(exp).contains("shot"))
                   .withColumn("n_shots", extract_int(F.col(exp), r"(\d+)shot")))


def method_comparison(summary: DataFrame, metrics: list[str], method: str = "method") -> DataFrame:
    """Mean of each metric per method over single-task runs."""
    return single_task(summary).groupBy(method).agg(*[F.avg(m).alias(m) for m in metrics])


def learning_curve(summary: DataFrame, metrics: list[str], method: str = "method") -> DataFrame:
    """Few-shot curve per method, ordered by the shot count."""
    f = few_shot_runs(summary)
    return (f.groupBy(method, "n_shots").agg(*[F.avg(m).alias(m) for m in metrics])
             .orderBy(method, "n_shots"))


def capitalize(c: Column) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def mean_std_text(mean: Column, std: Column) -> Column:
    """``$m \\pm s$`` with one decimal; std omitted when null or 0 (E5).

    Values are rounded to one decimal before formatting so that engines that
    break ``%.1f`` ties differently agree."""
    m = F.format_string("%.1f", F.round(mean, 1))
    s = F.format_string("%.1f", F.round(std, 1))
    return F.when(std.isNotNull() & (std > 0), F.concat(F.lit("$"), m, F.lit(" \\pm "), s, F.lit("$"))) \
            .otherwise(F.concat(F.lit("$"), m, F.lit("$")))


def mean_std_rows(summary: DataFrame, metrics: list[str], method: str = "method") -> DataFrame:
    """E5 + S10: one table row string per method."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"_m_{m}"), F.stddev_samp(m).alias(f"_s_{m}")]
    g = summary.groupBy(method).agg(*aggs)
    cells = [mean_std_text(F.col(f"_m_{m}"), F.col(f"_s_{m}")) for m in metrics]
    row = F.concat(F.concat_ws(" & ", capitalize(F.col(method)), *cells), F.lit(" \\\\"))
    return g.select(method, *[c.alias(m) for c, m in zip(cells, metrics)], row.alias("row"))


def baseline_delta(df: DataFrame, keys: list[str], method: str, metric: str, baseline: str) -> DataFrame:
    """Each method's metric minus the baseline method's at the same keys."""
    b = df.where(F.col(method) == baseline).select(*keys, F.col(metric).alias("baseline"))
    return df.join(b, keys, "left").withColumn("delta", F.col(metric) - F.col("baseline"))


def paired_t(df: DataFrame, pair_key: str, method: str, metric: str, a: str, b: str) -> DataFrame:
    """Paired t statistic of ``a - b`` over keys present for both methods."""
    x = df.where(F.col(method) == a).select(pair_key, F.col(metric).alias("_a"))
    y = df.where(F.col(method) == b).select(pair_key, F.col(metric).alias("_b"))
    d = x.join(y, pair_key).select((F.col("_a") - F.col("_b")).alias("d"))
    s = d.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"))
    t = F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt(F.col("n_pairs")))
    s = s.withColumn("t_stat", t).withColumn("df", (F.col("n_pairs") - 1).cast("int"))
    s = s.withColumn("t_crit", t_critical(F.col("df"))).withColumn("p_value", t_p_value(F.col("t_stat"), F.col("df")))
    return s.withColumn("significant", F.coalesce(F.abs("t_stat") > F.col("t_crit"), F.lit(False))) \
            .withColumn("method_a", F.lit(a)).withColumn("method_b", F.lit(b))


def cohens_d(df: DataFrame, method: str, metric: str, baseline: str) -> DataFrame:
    """``(mean - mean_base) / pooled sample std`` for every method vs the baseline."""
    g = df.groupBy(method).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("m"), F.var_samp(metric).alias("v"))
    b = g.where(F.col(method) == baseline).select(F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    j = g.where(F.col(method) != baseline).crossJoin(F.broadcast(b))  # b is one row
    pooled = F.sqrt(((F.col("n") - 1) * F.col("v") + (F.col("nb") - 1) * F.col("vb")) / (F.col("n") + F.col("nb") - 2))
    return j.select(method, F.try_divide(F.col("m") - F.col("mb"), pooled).alias("cohens_d"))


def success_flags(gaps: DataFrame, n: str, gap: str, min_gap: float, n_focus: int, focus_gap: float) -> DataFrame:
    """Gap >= min_gap at every n; gap at ``n_focus`` >= focus_gap; the gap
    widens as n falls (each smaller n has a gap >= the next larger n)."""
    w = Window.orderBy(n)  # one row per shot count: a handful of rows
    g = gaps.withColumn("_next", F.lead(gap).over(w))
    return g.agg(F.bool_and(F.col(gap) >= min_gap).alias("all_above"),
                 F.coalesce(F.max(F.when(F.col(n) == n_focus, F.col(gap) >= focus_gap)), F.lit(False)).alias("focus_ok"),
                 F.bool_and(F.coalesce(F.col(gap) >= F.col("_next"), F.lit(True))).alias("widening"))


def ablation_delta(parts: DataFrame, part: str, num: str, den: str) -> DataFrame:
    """Metric of the full set vs the set without each part (ratio metric
    ``sum(num) / sum(den)``); delta = without - full."""
    tot = parts.agg(F.sum(num).alias("_N"), F.sum(den).alias("_D"))
    j = parts.crossJoin(F.broadcast(tot))  # one row
    full = F.col("_N") / F.col("_D")
    wo = F.try_divide(F.col("_N") - F.col(num), F.col("_D") - F.col(den))
    return j.select(F.concat(F.lit("without_"), F.col(part)).alias("variant"), full.alias("full"),
                    wo.alias("metric"), (wo - full).alias("delta"))
