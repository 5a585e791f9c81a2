"""Trained probe (C1) and projections of groups of different rank (N5, N6) against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import matrix as N
from corpusflow.operators import probe as P


def features(spark, n=300, seed=3, labels=(2, 5, 9)):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, len(labels), n)
    x = rng.normal(size=(n, 4)) + np.eye(4)[y % 4] * 1.5
    df = spark.createDataFrame([(i, labels[k], v.tolist()) for i, (k, v) in enumerate(zip(y, x))], "id long, label int, v array<float>")
    return df, y, x.astype(np.float32).astype(float)


def descend(x, y, k, steps, rate, l2):
    x = np.hstack([x, np.ones((len(x), 1))])
    W, losses = np.zeros((k, x.shape[1])), []
    for _ in range(steps + 1):
        z = x @ W.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean() + l2 / 2 * (W * W).sum())
        last = W
        W = W - rate * ((p - np.eye(k)[y]).T @ x / len(y) + l2 * W)
    return last, losses


def test_training_equals_plain_descent_at_any_partitioning(spark):
    df, y, x = features(spark)
    unused = spark.createDataFrame([(900, None, [1.0, 2.0, 3.0, 4.0]), (901, 2, None)], df.schema)
    W, losses = descend(x, y, 3, 7, 0.4, 0.02)
    for some in (df, df.unionByName(unused).repartition(7)):
        h = P.train_probe(some, "label", "v", steps=7, rate=0.4, l2=0.02).orderBy("step").collect()
        assert [r["step"] for r in h] == list(range(8)) and h[0]["classes"] == [2, 5, 9] and h[-1]["n_rows"] == 300
        assert np.allclose([r["loss"] for r in h], losses, atol=1e-9) and losses == sorted(losses, reverse=True)
        assert np.allclose(h[-1]["W"], W, atol=1e-9)
    probs = P.apply_probe(df, "v", P.train_probe(df, "label", "v", steps=7, rate=0.4, l2=0.02), 7).orderBy("id").collect()
    z = np.hstack([x, np.ones((len(x), 1))]) @ W.T
    assert [int(np.argmax(r["probs"])) for r in probs] == z.argmax(1).tolist()


def test_training_goes_on_from_its_last_step(spark, tmp_path):
    df, y, x = features(spark, seed=4)
    state = f"file://{tmp_path}/state"
    P.train_probe(df, "label", "v", steps=2, rate=0.4, state=state)
    marks = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "state").iterdir()}
    h = P.train_probe(df, "label", "v", steps=5, rate=0.4, state=state).orderBy("step").collect()
    assert np.allclose([r["loss"] for r in h], descend(x, y, 3, 5, 0.4, 0.0)[1], atol=1e-9)
    assert all((tmp_path / "state" / n).stat().st_mtime_ns == t for n, t in marks.items())
    assert P.train_probe(df, "label", "v", steps=3, rate=0.4, state=state).count() == 4


def test_training_needs_a_labelled_vector(spark):
    df, _, _ = features(spark, n=3)
    with pytest.raises(ValueError, match="no labelled vector"):
        P.train_probe(df.where("label > 100"), "label", "v", steps=1, rate=0.1)


@pytest.mark.parametrize("mode", ["kaiming", "normal"])
def test_bases_are_seeded_and_solved(mode):
    A = N.seeded_rows("g", 5, 16, 42, mode)
    assert (A == N.seeded_rows("g", 5, 16, 42, mode)).all() and not (A == N.seeded_rows("h", 5, 16, 42, mode)).any()
    if mode == "kaiming":
        assert np.abs(A).max() <= 0.25 and np.abs(A @ A.T - np.eye(5)).max() > 0.3  # far from unit rows
    eps = 1e-6
    assert np.allclose(N.solve_gram(A, eps), np.linalg.inv(A @ A.T + eps * np.eye(5)) @ A)


def test_groups_of_different_rank(spark):
    rng = np.random.default_rng(8)
    groups = {"a": 2, "b": 7, "c": 40, "none": 0}
    rows = [(i, g, rng.normal(size=16).tolist()) for i, g in enumerate(rng.choice(list(groups), 80))]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    ranks = spark.createDataFrame([(g, r) for g, r in groups.items()], "g string, rank int")
    bases = N.group_bases(ranks, "g", "rank", 16, seed=1)
    projected = N.project_groups(df, "g", "v", bases)
    got = {r["id"]: r["B"] for r in projected.collect()}
    assert set(got) == {i for i, g, _ in rows if g != "none"}
    error = {r["g"]: r for r in N.group_approx_error(projected, "g", "v").collect()}
    for g in ("a", "b", "c"):
        A = N.seeded_rows(g, min(groups[g], 16), 16, 1)
        G = np.array([v for _, h, v in rows if h == g])
        B = -G @ A.T @ np.linalg.inv(A @ A.T + 1e-6 * np.eye(len(A)))
        assert np.allclose([got[i] for i, h, _ in rows if h == g], B)
        assert error[g]["rank"] == len(A) and error[g]["n_rows"] == len(G)
        assert abs(error[g]["rel_error"] - np.linalg.norm(B @ A + G) / np.linalg.norm(G)) < 1e-6
    assert error["c"]["rel_error"] < 0.01 < error["b"]["rel_error"] < error["a"]["rel_error"]
    assert projected.where(F.col("id") < 0).count() == 0
