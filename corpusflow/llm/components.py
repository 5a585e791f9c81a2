"""Connected components by alternating large-star and small-star rounds.

Every round rewires each node's larger neighbours to the smallest label it can
see (large star) and then its smaller ones to that label (small star); after
O(log n) rounds every component is a star around its smallest node.  Each step
is a grouped minimum (pre-aggregated before the shuffle) and an equi-join that
AQE can split where a hub holds many edges.  Rounds are written with
``checkpoint()``; only (count, checksum) pairs of the edge table reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import cut


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation on edges (u, v) with u < v."""
    if larger:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("n"), F.least("u", "m").alias("m"))
    hit = near.join(low, near["u"] == low["n"])
    if larger:
        out = hit.where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v")
    else:
        out = hit.select(F.col("m").alias("u"), F.col("v").alias("v")).unionByName(
            low.select(F.col("m").alias("u"), F.col("n").alias("v")))
    return out.where(F.col("u") < F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is its component's smallest node.

    Edges may repeat, point either way or be loops; null ends are ignored.  An
    empty edge table gives an empty result.
    """
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        e = cut(_star(_star(e, True), False))
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
