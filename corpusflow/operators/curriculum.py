"""Probe, entropy, curriculum bins and schedule, soft labels.

Features are the ``embedding`` arrays.  The deterministic probe uses class
centroids as weights (logits = x . centroid_k).  The centroid matrix has
``classes x dim`` numbers, so it is built by aggregation and broadcast as a
single row; scoring is then a map-side array expression, with no shuffle of
the feature rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.hashing import uniform
from corpusflow.operators.ranks import class_rank, global_rank, ntile_from_rank
from corpusflow.functions.hashing import hash_order


def as_double_array(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Per-class mean vector: ``(label, centroid array<double>)``."""
    # *_outer generators: Spark infers no size() filter for them, so the array
    # expression is not re-evaluated in pushed-down predicates
    ex = (df.select(label, F.posexplode_outer(as_double_array(F.col(vec))).alias("pos", "x"))
            .where(F.col("pos").isNotNull()))
    m = ex.groupBy(label, "pos").agg(F.avg("x").alias("v"))
    return (m.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s"))
             .select(label, F.transform("_s", lambda s: s["v"]).alias("centroid")))


def centroid_matrix(df: DataFrame, label: str, vec: str) -> DataFrame:
    """One row: ``classes`` (sorted labels) and ``W`` (their centroids)."""
    c = centroids(df, label, vec)
    s = c.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), "centroid"))).alias("_m"))
    return s.select(F.transform("_m", lambda m: m["k"]).alias("classes"),
                    F.transform("_m", lambda m: m["centroid"]).alias("W"))


def probe_logits(df: DataFrame, label: str, vec: str, out: str = "logits",
                 fit: DataFrame | None = None) -> DataFrame:
    """Centroid probe (C1): ``logits[k] = x . centroid_k`` for sorted classes.

    Centroids come from ``fit`` (default: ``df`` itself)."""
    M = centroid_matrix(df if fit is None else fit, label, vec)
    x = as_double_array(F.col(vec))
    # M is one row of classes x dim numbers: broadcasting it is bounded by the model size
    j = df.crossJoin(F.broadcast(M))
    return j.withColumn(out, F.transform("W", lambda w: dot(x, w))).drop("W")


def softmax(logits: Column) -> Column:
    """Stable softmax (subtract the max)."""
    m = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / s)


def entropy(probs: Column) -> Column:
    """``H = -sum p ln p`` (C2); zero probabilities contribute 0."""
    return -F.aggregate(probs, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(0.0))


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum (M1)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def tertiles(df: DataFrame, score: Column, key: str, digits: int = 9, out: str = "bin") -> DataFrame:
    """Easy / medium / hard thirds by ascending score (C3, W4, T11): returns
    ``key, tertile, bin``.

    The score is rounded to ``digits`` so the order does not depend on the
    last bits of a float sum; ties go by ``key``.  The rank is global but
    computed per range partition (``global_rank``), not in one task.
    """
    x = df.select(key, F.round(score, digits).alias("_sc"))
    r = global_rank(x, ["_sc"], key)
    n = x.agg(F.count(F.lit(1)).alias("_N"))
    r = r.crossJoin(F.broadcast(n))  # one-row count
    t = ntile_from_rank(F.col("rank"), F.col("_N"), 3)
    names = F.array(F.lit("easy"), F.lit("medium"), F.lit("hard"))
    return r.withColumn("tertile", t).withColumn(out, F.element_at(names, t)).drop("_sc", "_N", "rank")


# Phase schedule (phase, highest bin admitted, share of steps
# from, share of steps to); augmented rows are used in phases 2 and 3.
PHASES = [(1, 1, 0.0, 0.2), (2, 2, 0.2, 0.6), (3, 3, 0.6, 1.0)]
AUGMENT_PHASES = (2, 3)


def schedule(binned: DataFrame, batch: int, epochs: int, tertile: str = "tertile") -> DataFrame:
    """Rows and step range per phase (C4); augmented-row count.

    Total steps = ``ceil(rows / batch) * epochs``.

    Rows are counted per bin first (3 rows), then joined with the 3-row phase
    table on ``bin <= max_bin``; both sides are fixed-size.
    """
    spark = binned.sparkSession
    ph = spark.createDataFrame(PHASES, "phase int, max_bin int, share_from double, share_to double")
    per_bin = binned.groupBy(tertile).agg(F.count(F.lit(1)).alias("_n"))
    tot = binned.agg(F.count(F.lit(1)).alias("_N"))
    j = ph.join(F.broadcast(per_bin), F.col(tertile) <= F.col("max_bin"), "left")
    g = j.groupBy("phase", "max_bin", "share_from", "share_to").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_rows"))
    g = g.crossJoin(F.broadcast(tot))  # one-row count
    s = F.ceil(F.col("_N") / batch) * epochs
    return g.select("phase", "max_bin", "n_rows",
                    F.floor(F.col("share_from") * s).cast("bigint").alias("from_step"),
                    F.floor(F.col("share_to") * s).cast("bigint").alias("to_step"),
                    F.when(F.col("phase").isin(*AUGMENT_PHASES), F.col("n_rows")).otherwise(F.lit(0)).cast("bigint").alias("n_augmented"))


def beta_inverse_cdf_table(a: float, b: float, n: int = 1000) -> list[float]:
    """Inverse CDF of Beta(a, b) at u = 0, 1/n, ..., 1 (midpoint-rule CDF on a
    fine grid in the substitution x = sin^2 t, which removes the endpoint
    singularities for a, b < 1)."""
    m = 20000
    ts = [(i + 0.5) * (math.pi / 2) / m for i in range(m)]
    dens = [2 * math.sin(t) ** (2 * a - 1) * math.cos(t) ** (2 * b - 1) for t in ts]
    total = sum(dens)
    cdf, acc = [], 0.0
    for dd in dens:
        acc += dd
        cdf.append(acc / total)
    out, j = [], 0
    for i in range(n + 1):
        u = i / n
        while j < m - 1 and cdf[j] < u:
            j += 1
        out.append(math.sin(ts[j]) ** 2 if 0 < i < n else float(i == n))
    return out


def mixup_pairs(df: DataFrame, key: str, vec: str, label: str, seed, block: list[str] | None = None,
                lam: float | None = None, alpha: float = 0.4) -> DataFrame:
    """Mixup (C5): each row is paired with the next row in seeded order inside
    its block (the last with the first); ``lam`` fixed, or drawn from
    Beta(alpha, alpha) by an inverse-CDF table on the seeded uniform.

    Output: key, partner key, lambda, mixed vector, soft weight of the own label.
    """
    block = block or []
    r = class_rank(df, block, hash_order(seed, key), key, out="_r")
    n = df.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")) if block else df.agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n, block) if block else r.crossJoin(F.broadcast(n))
    r = r.withColumn("_pr", F.when(F.col("_r") == F.col("_n"), F.lit(1)).otherwise(F.col("_r") + 1).cast("bigint"))
    p = r.select(*block, F.col("_r").alias("_pr"), F.col(key).alias("partner"), F.col(vec).alias("_pv"),
                 F.col(label).alias("_pl"))
    j = r.join(p, [*block, "_pr"])
    if lam is None:
        table = F.array(*[F.lit(x) for x in beta_inverse_cdf_table(alpha, alpha)])
        at = uniform(f"{seed}:lam", key) * 1000  # between two points of the table
        low = F.element_at(table, (F.floor(at) + 1).cast("int"))
        high = F.element_at(table, (F.floor(at) + 2).cast("int"))
        lam_c = low + (high - low) * (at - F.floor(at))
    else:
        lam_c = F.lit(float(lam))
    j = j.withColumn("lam", lam_c)
    x1, x2 = as_double_array(F.col(vec)), as_double_array(F.col("_pv"))
    mixed = F.zip_with(x1, x2, lambda a, b: F.col("lam") * a + (1 - F.col("lam")) * b)
    own = F.col("lam") + F.when(F.col(label) == F.col("_pl"), 1 - F.col("lam")).otherwise(0.0)
    return j.select(key, "partner", "lam", mixed.alias("mixed"), own.alias("own_label_weight"),
                    F.col(label), F.col("_pl").alias("partner_label"))


def label_smoothing(label: Column, num_labels: int, eps: float) -> Column:
    """Soft label ``(1-eps) 1[y=k] + eps/K`` as an array over k."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_labels - 1)),
                       lambda k: F.when(k == label, 1 - eps).otherwise(0.0) + eps / num_labels)


def cross_entropy(p_true: Column) -> Column:
    """``-ln p_y``."""
    return -F.log(p_true)


def generalized_ce(p_true: Column, q: float = 0.7) -> Column:
    """``(1 - p_y^q) / q``."""
    return (1 - F.pow(p_true, q)) / q


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroid_cosine(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Cosine between every pair of group centroids (C8); groups x groups."""
    c = centroids(df, group, vec)
    a = c.select(F.col(group).alias("g1"), F.col("centroid").alias("c1"))
    b = c.select(F.col(group).alias("g2"), F.col("centroid").alias("c2"))
    # centroids are one row per group: the pair table is groups^2, bounded by the class count
    return a.join(b, F.col("g1") < F.col("g2")).select("g1", "g2", cosine(F.col("c1"), F.col("c2")).alias("cosine"))
