"""Lookups of array elements in a small table, inside the row.

A join needs a row per element; taking the rows apart and putting them together
again costs an exchange of all elements.  A table of a checked size becomes a
constant of the plan instead: an array of hash buckets (about one entry each),
so an element finds its value by one array access, and rows stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.ranks import table_bytes
from corpusflow.session import checkpoint_dir

#: Largest table, in bytes of its rows, that becomes a constant of the plan.
LOOKUP_BYTES = 8 << 20


def row_lookup(table: DataFrame, key: str, value: str, max_bytes: int | None = None) -> Callable[[Column], Column] | None:
    """A function from a key column to its value (null where the table has none), or None if the table is over
    ``max_bytes`` (default ``LOOKUP_BYTES``) and has to be joined.

    ``key`` is a string; of equal keys the smallest value counts; null keys and values are left out.
    """
    spark = table.sparkSession
    checkpoint_dir(spark)
    t = table.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(value).alias("v"))
    t = t.checkpoint(eager=True)
    if table_bytes(t) > (LOOKUP_BYTES if max_bytes is None else max_bytes):
        return None
    n = 1
    rows = t.select("k", "v", F.xxhash64("k").alias("h")).collect()  # of a checked size
    while n < len(rows):
        n *= 2
    buckets = [[] for _ in range(n)]
    for r in rows:
        buckets[r["h"] % n].append({"k": r["k"], "v": r["v"]})
    kind = t.schema["v"].dataType.simpleString()
    entries = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<k: string, v: {kind}>>>")

    def look_up(k: Column) -> Column:
        bucket = F.get(entries, F.pmod(F.xxhash64(k), F.lit(n)).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["k"] == k), F.lit(0))["v"]

    return look_up
