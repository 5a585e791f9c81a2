"""Low-rank projection against numpy on a small distributed matrix."""

import numpy as np

from corpusflow.operators import matrix as N


def test_low_rank_projection_matches_numpy(spark):
    rng = np.random.default_rng(0)
    G = rng.standard_normal((30, 12))
    df = spark.createDataFrame([(i, [float(x) for x in G[i]]) for i in range(30)], "row int, g array<double>")
    for mode in ("kaiming", "normal"):
        A = N.random_rows(4, 12, seed=7, mode=mode)
        p = N.low_rank_project(df, "g", A, eps=1e-6)
        got = np.array([r.B for r in p.orderBy("row").collect()])
        exp = -G @ A.T @ np.linalg.inv(A @ A.T + 1e-6 * np.eye(4))
        assert np.allclose(got, exp, rtol=1e-9, atol=1e-9)
        err = N.approx_error(p, "g", "B", A).collect()[0].rel_error
        assert abs(err - np.linalg.norm(exp @ A + G) / np.linalg.norm(G)) < 1e-9


def test_kaiming_bounds():
    A = N.random_rows(8, 64, seed=1)
    assert A.shape == (8, 64) and np.abs(A).max() <= 1 / np.sqrt(64)


def test_gradient_accumulation_matches_numpy(spark):
    from corpusflow.functions.hashing import hash_order
    rng = np.random.default_rng(3)
    X = rng.standard_normal((21, 5)).astype(np.float32)
    y = rng.integers(0, 3, 21)
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(21)],
                               "vec_id long, embedding array<float>, label int")
    scored = N.batched_probe(df, "vec_id", "label", "embedding", n=17, batch=4, seed=5)
    G = {(r.k, r.j): r.g for r in N.accumulate_gradient(scored, "embedding").collect()}
    # numpy: centroid weights, sample of 17 in md5 order, batches of 4 (last one short)
    Xd = X.astype(np.float64)
    classes = sorted(set(int(v) for v in y))
    W = np.array([Xd[y == c].mean(axis=0) for c in classes])
    order = [r.vec_id for r in df.select("vec_id", hash_order(5, "vec_id").alias("h")).orderBy("h", "vec_id").collect()][:17]
    exp = np.zeros_like(W)
    for b in range(0, 17, 4):
        idx = order[b:b + 4]
        logits = Xd[idx] @ W.T
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        onehot = np.array([[1.0 if classes[k] == y[i] else 0.0 for k in range(len(classes))] for i in idx])
        exp += (p - onehot).T @ Xd[idx] / len(idx)
    for k in range(len(classes)):
        for j in range(5):
            assert abs(G[(k, j)] - exp[k, j]) < 1e-9


def test_beta_inverse_cdf_table():
    from corpusflow.operators.curriculum import beta_inverse_cdf_table
    t = beta_inverse_cdf_table(0.4, 0.4)
    assert t[0] == 0.0 and t[-1] == 1.0 and all(a <= b for a, b in zip(t, t[1:]))
    assert abs(t[500] - 0.5) < 1e-3  # symmetric distribution: median 0.5
    assert abs(sum(t) / len(t) - 0.5) < 1e-3
