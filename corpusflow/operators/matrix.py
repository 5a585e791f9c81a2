"""Gradient accumulation, importance and low-rank projection.

The model is a softmax-linear probe on the ``embedding`` features whose
weights are the class centroids (see ``curriculum.probe_logits``).  The
gradient sample is ``min(n, rows)`` rows (the reference samples a fixed
number), so its long form ``rows x classes x dim`` is bounded by the sample
size; it is summed with a partial + final hash aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.curriculum import as_double_array, dot, probe_logits, softmax
from corpusflow.operators.ranks import bounded_broadcast
from corpusflow.operators.sampling import sample_exact


def batched_probe(df: DataFrame, key: str, label: str, vec: str, n: int, batch: int, seed) -> DataFrame:
    """Sample ``n`` rows, assign batches of ``batch`` in sample order, score the
    probe.  Adds ``batch_id``, ``batch_n`` (rows in the batch), ``probs``,
    ``resid`` (p - onehot) and ``ce`` (-ln p_y)."""
    from corpusflow.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    # the sample has at most n rows (a parameter) and is read by several
    # branches below: materialise it once
    s = sample_exact(df, n, seed, key, out="sample_rank").checkpoint(eager=True)
    s = s.withColumn("batch_id", F.floor((F.col("sample_rank") - 1) / batch).cast("bigint"))
    sizes = s.groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_n"))  # n / batch rows
    s = s.join(F.broadcast(sizes), "batch_id")
    lg = probe_logits(s, label, vec, fit=df).withColumn("probs", softmax(F.col("logits")))
    onehot = F.transform("classes", lambda k: F.when(k == F.col(label), 1.0).otherwise(0.0))
    pos = F.array_position("classes", F.col(label)).cast("int")
    return (lg.withColumn("resid", F.zip_with("probs", onehot, lambda p, y: p - y))
              .withColumn("ce", -F.log(F.element_at("probs", pos))))


def accumulate_gradient(scored: DataFrame, vec: str) -> DataFrame:
    """``G[k, j] = sum_b 1/|b| sum_{i in b} (p_ik - y_ik) x_ij`` (sum of the
    gradients of each batch-mean loss; not divided by the number of batches)."""
    # *_outer generators: no inferred size() filter that would re-run the probe
    # expressions inside pushed-down predicates
    x = scored.select(F.col("batch_n"), as_double_array(F.col(vec)).alias("_x"),
                      F.posexplode_outer("resid").alias("k", "rk"))
    x = x.select("batch_n", "k", "rk", F.posexplode_outer("_x").alias("j", "xj"))
    return x.where(F.col("k").isNotNull() & F.col("j").isNotNull()).groupBy("k", "j").agg(F.sum(F.col("rk") * F.col("xj") / F.col("batch_n")).alias("g"))


def batch_mean_loss(scored: DataFrame) -> DataFrame:
    """Mean over batches of the batch-mean loss (each batch weighs equally)."""
    per = scored.groupBy("batch_id").agg(F.avg("ce").alias("_l"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("_l").alias("avg_loss"))


def weights_long(M: DataFrame) -> DataFrame:
    """The probe weight matrix (one row ``W``) as ``(k, j, w)``."""
    r = M.select(F.posexplode("W").alias("k", "row"))
    return r.select("k", F.posexplode("row").alias("j", "w"))


def importance(W: DataFrame, G: DataFrame, name: Column) -> DataFrame:
    """N3 + J2: ``mean(|W| * |G|)`` per matrix row, W joined to G on (k, j)
    (inner: only cells that have a gradient)."""
    j = W.join(G, ["k", "j"])
    return j.groupBy("k").agg(F.avg(F.abs("w") * F.abs("g")).alias("importance")).withColumn("name", name)


def projection_matrix(A: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """``Aᵀ (A Aᵀ + eps I)⁻¹`` for an ``r x k`` A (r <= rank parameter): an
    ``r x r`` solve on the driver, returned transposed (``r x k``)."""
    r = A.shape[0]
    P = A.T @ np.linalg.inv(A @ A.T + eps * np.eye(r))
    return P.T


def low_rank_project(df: DataFrame, vec: str, A: np.ndarray, eps: float = 1e-6, out: str = "B") -> DataFrame:
    """``B_i = -G_i Aᵀ (A Aᵀ + eps I)⁻¹`` per distributed row ``G_i``.

    ``A`` has ``r x k`` numbers (r = min(rank, d, k)); the projection is a
    literal in the plan and every row is projected map-side.
    """
    Pt = projection_matrix(np.asarray(A, dtype=float), eps)
    cols = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in Pt])
    g = as_double_array(F.col(vec))
    return df.withColumn(out, F.transform(cols, lambda p: -dot(g, p)))


def approx_error(df: DataFrame, vec: str, B: str, A: np.ndarray) -> DataFrame:
    """``||B A + G||_F / ||G||_F`` over all rows."""
    A = np.asarray(A, dtype=float)
    k = A.shape[1]
    cols = [F.array(*[F.lit(float(A[c, j])) for c in range(A.shape[0])]) for j in range(k)]
    g = as_double_array(F.col(vec))
    recon = F.array(*[dot(F.col(B), cols[j]) for j in range(k)])
    resid = F.zip_with(recon, g, lambda a, b: a + b)
    return df.agg((F.sqrt(F.sum(dot(resid, resid))) / F.sqrt(F.sum(dot(g, g)))).alias("rel_error"))


def unit_rows(r: int, k: int) -> np.ndarray:
    """The first ``r`` unit vectors of R^k (a deterministic A)."""
    A = np.zeros((r, k))
    A[np.arange(r), np.arange(r)] = 1.0
    return A


def random_rows(r: int, k: int, seed: int, mode: str = "kaiming") -> np.ndarray:
    """A seeded ``r x k`` projection basis (N5): ``kaiming`` = uniform in
    ``[-1/sqrt(k), 1/sqrt(k)]`` (Kaiming-uniform with a = sqrt(5) for fan-in
    k), ``normal`` = N(0, 1) * 0.01.  It is ``r x k`` numbers, built on the
    driver and used as a literal."""
    rng = np.random.default_rng(seed)
    if mode == "kaiming":
        b = 1.0 / np.sqrt(k)
        return rng.uniform(-b, b, size=(r, k))
    if mode == "normal":
        return rng.standard_normal((r, k)) * 0.01
    raise ValueError(f"unknown init mode {mode!r}")


def classify_vectors(mean: Column, std: Column) -> Column:
    """Random (|mean| < 1e-6 and std < 0.02), warm (|mean| > 1e-4 or
    std > 0.05), else unclear."""
    return (F.when((F.abs(mean) < 1e-6) & (std < 0.02), "random")
             .when((F.abs(mean) > 1e-4) | (std > 0.05), "warm").otherwise("unclear"))


def majority_verdict(n_random: Column, n_warm: Column, n: Column) -> Column:
    """Majority at > 50 %: random, warm, else mixed."""
    return F.when(n_random > 0.5 * n, "random").when(n_warm > 0.5 * n, "warm").otherwise("mixed")


def seeded_rows(group, r: int, k: int, seed, mode: str = "kaiming") -> np.ndarray:
    """A group's own ``r x k`` basis (N5) from md5 draws, so that any engine gets the same numbers.

    Cell (i, j) is drawn from ``md5(seed|group|i|j)``: uniform in ``[-1/sqrt(k), 1/sqrt(k)]`` (``kaiming``) or
    N(0, 1) * 0.01 by the inverse of two such draws (``normal``, Box-Muller)."""
    import hashlib

    def draw(*key) -> float:
        return int(hashlib.md5("|".join(map(str, (seed, group, *key))).encode()).hexdigest()[:8], 16) / 4294967296.0

    if mode == "kaiming":
        return np.array([[(2 * draw(i, j) - 1) / np.sqrt(k) for j in range(k)] for i in range(r)]).reshape(r, k)
    if mode == "normal":
        return np.array([[0.01 * np.sqrt(-2 * np.log(draw(i, j, "r") + 2.0 ** -33)) * np.cos(2 * np.pi * draw(i, j, "a"))
                          for j in range(k)] for i in range(r)]).reshape(r, k)
    raise ValueError(f"unknown init mode {mode!r}")


def solve_gram(A: np.ndarray, eps: float) -> np.ndarray:
    """``(A A^T + eps I)^-1 A``: the Gram matrix is symmetric and positive definite, so by its Cholesky factor."""
    L = np.linalg.cholesky(A @ A.T + eps * np.eye(len(A)))
    return np.linalg.solve(L.T, np.linalg.solve(L, A))


def group_bases(ranks: DataFrame, group: str, rank: str, width: int, *, seed=42, mode: str = "kaiming", eps: float = 1e-6) -> DataFrame:
    """One row per group: ``A`` (``min(rank, width) x width``) and ``P`` (as many rows, ``G P^T = G A^T (A A^T + eps I)^-1``).

    ``ranks`` has one row per group, as an allocation gives them; ranks may differ between groups.  Groups are
    solved in parallel, each in the task that holds its row.  Groups without a rank, or with rank 0, have no row.
    """
    kind = ranks.schema[group].dataType.simpleString()

    def solve(frames):
        for f in frames:
            A = [seeded_rows(g, min(int(r), width), width, seed, mode) for g, r in zip(f["g"], f["r"])]
            f = f[["g"]].assign(A=[a.tolist() for a in A], P=[solve_gram(a, eps).tolist() for a in A])
            yield f

    some = ranks.where(F.col(rank) > 0).select(F.col(group).alias("g"), F.col(rank).cast("int").alias("r"))
    return some.mapInPandas(solve, f"g {kind}, A array<array<double>>, P array<array<double>>").withColumnRenamed("g", group)


def project_groups(df: DataFrame, group: str, vec: str, bases: DataFrame, out: str = "B") -> DataFrame:
    """N5 for groups of different rank: ``B_i = -G_i A^T (A A^T + eps I)^-1`` with the basis of row i's group.

    The bases (groups x rank x width numbers) are written once and broadcast only below a checked size; beyond it
    they meet the rows by a join on the group.  Rows of groups without a basis are left out.
    """
    small = bounded_broadcast(bases)
    g = as_double_array(F.col(vec))
    return df.join(small, group).withColumn(out, F.transform("P", lambda p: -dot(g, p))).drop("P")


def group_approx_error(projected: DataFrame, group: str, vec: str, B: str = "B") -> DataFrame:
    """N6 per group: ``||B A + G||_F / ||G||_F`` over the rows that ``project_groups`` gives, with their ``A``."""
    g = as_double_array(F.col(vec))
    zero = F.transform(g, lambda x: F.lit(0.0))
    recon = F.aggregate(F.zip_with(B, "A", lambda b, a: F.transform(a, lambda x: b * x)), zero,
                        lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y))
    parts = projected.select(group, F.size(B).alias("r"), F.zip_with(recon, g, lambda x, y: x + y).alias("_d"), g.alias("_g"))
    return parts.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.max("r").alias("rank"),
                                    F.try_divide(F.sqrt(F.sum(dot(F.col("_d"), F.col("_d")))), F.sqrt(F.sum(dot(F.col("_g"), F.col("_g"))))).alias("rel_error"))
