"""A linear softmax probe trained by distributed full-batch gradient descent.

The features are written once as a narrow table (class number and vector).  A
step is one pass over it: every task adds up the gradient of its rows in numpy
(Arrow batches in, ``classes x (dim + 1)`` sums out) and Spark adds up the
tasks' sums, so rows never move.  The weights are as many numbers; they travel
to the tasks inside the function and are written after every step, so a run that
is cut short goes on from its last step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.curriculum import as_double_array, dot, softmax
from corpusflow.session import scratch_dir

STATE = "loss double, grad_norm double, n_rows long, classes array<int>, W array<array<double>>"


def _features(df: DataFrame, label: str, vec: str, classes: list[int]) -> DataFrame:
    """``y`` (position of the label in ``classes``) and ``x`` with a constant 1 at its end, written once."""
    spark = df.sparkSession
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("int")) - 1
    x = F.concat(as_double_array(F.col(vec)), F.array(F.lit(1.0)))
    path = scratch_dir(spark, "probe-features")
    df.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(y.cast("int").alias("y"), x.alias("x")).write.parquet(path)
    return spark.read.parquet(path)


def _pass(features: DataFrame, W: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Sum of the gradient, sum of the cross-entropy and number of rows, over all features."""
    shape = W.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(W.size + 1), 0
        for batch in batches:
            y = np.asarray(batch.column("y"))
            x = np.asarray(batch.column("x").flatten()).reshape(len(y), shape[1])
            logits = x @ W.T
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            own = np.arange(len(y)), y
            total[-1] -= np.log(p[own]).sum()
            p[own] -= 1.0
            total[:-1] += (p.T @ x).ravel()
            n += len(y)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(W.size + 1), pa.int32()), "s": pa.array(total), "n": pa.array(np.full(W.size + 1, n), pa.int64())})

    sums = features.mapInArrow(partial, "at int, s double, n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rows = sums.collect()  # one row a weight
    total = np.zeros(W.size + 1)
    for r in rows:
        total[r["at"]] = r["s"]
    return total[:-1].reshape(shape), float(total[-1]), rows[0]["n"] if rows else 0


def train_probe(df: DataFrame, label: str, vec: str, *, steps: int, rate: float, l2: float = 0.0, state: str | None = None) -> DataFrame:
    """``steps`` gradient steps from zero weights on the mean cross-entropy (plus ``l2 / 2`` times the squared weights).

    One row per step 0..``steps``: ``step``, ``loss`` and ``grad_norm`` at that step's weights, ``n_rows``,
    ``classes`` (sorted labels) and ``W`` (a row a class, the last entry its bias).  Rows without a label or vector
    are not used.  ``state`` names the folder of the steps (default: a new one in the shared folder); steps already
    there are not run again.
    """
    spark = df.sparkSession
    state = state or scratch_dir(spark, "probe-state")
    done = _steps(spark, state)
    if done and done[-1]["step"] >= steps:
        return _history(spark, state, steps)
    classes = sorted(r[0] for r in df.where(F.col(vec).isNotNull()).select(F.col(label).cast("int")).distinct().collect() if r[0] is not None)
    if not classes:
        raise ValueError("no labelled vector")
    features = _features(df, label, vec, classes)
    width = features.select(F.max(F.size("x")).alias("w")).first()["w"]
    W, first = (np.array(done[-1]["W"]), done[-1]["step"] + 1) if done else (np.zeros((len(classes), width)), 0)
    if done:  # the next step's weights follow from the last one's
        W = W - rate * _gradient(*_pass(features, W)[::2], W, l2)
    for step in range(first, steps + 1):
        total, loss, n = _pass(features, W)
        g = _gradient(total, n, W, l2)
        row = [(loss / n + l2 / 2 * float((W * W).sum()), float(np.sqrt((g * g).sum())), n, classes, W.tolist())]
        spark.createDataFrame(row, STATE).coalesce(1).write.mode("overwrite").parquet(f"{state}/step={step}")
        W = W - rate * g
    return _history(spark, state, steps)


def _gradient(total: np.ndarray, n: int, W: np.ndarray, l2: float) -> np.ndarray:
    return total / n + l2 * W


def _history(spark, state: str, steps: int) -> DataFrame:
    return spark.read.schema(f"{STATE}, step int").option("basePath", state).parquet(state).where(F.col("step") <= steps)


def _steps(spark, state: str) -> list:
    from pyspark.errors import AnalysisException
    try:
        return _history(spark, state, 1 << 30).orderBy("step").collect()
    except AnalysisException:  # nothing there yet
        return []


def apply_probe(df: DataFrame, vec: str, history: DataFrame, step: int, probs: str = "probs") -> DataFrame:
    """Adds ``classes`` and class probabilities by the weights of a step.

    The weights are one row of ``classes x (dim + 1)`` numbers, so broadcasting them is bounded by the model."""
    model = history.where(F.col("step") == step).select("classes", "W")
    x: Column = F.concat(as_double_array(F.col(vec)), F.array(F.lit(1.0)))
    j = df.crossJoin(F.broadcast(model))
    return j.withColumn(probs, softmax(F.transform("W", lambda w: dot(x, w)))).drop("W")
