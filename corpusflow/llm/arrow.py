"""Small helpers for functions that work on Arrow batches of texts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpusflow

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(corpusflow.__file__)))


def parts(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[list[str]]:
    """The batch as lists of texts (null as empty) of about ``max_bytes`` each, in order.

    A text is never divided, so one that is longer makes a list of its own.
    """
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > max_bytes:
            yield [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += int(n)
    if start < len(sizes):
        yield [t or "" for t in texts.slice(start).to_pylist()]


def struct(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


#: Bytes of an Arrow batch, which stands in the executor's and the worker's memory at once.
BATCH_BYTES = 8 << 20


def on_workers() -> None:
    """Let Python workers started from here import this package where it lies at the same path,
    and send them batches of at most ``BATCH_BYTES``.

    On a cluster without such a path, ship the package with ``--py-files``.
    """
    spark = SparkSession.getActiveSession()
    limit = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b"))
    if limit <= 0 or limit > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def arrow_udf(kind: str):
    """``pyspark.sql.functions.arrow_udf`` whose workers can import this package."""
    on_workers()
    return F.arrow_udf(kind)
