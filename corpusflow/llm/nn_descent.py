"""Embedding near-dedup by NN-descent.

Equal vectors collapse to one node first.  Neighbour lists start from random
hyperplane leaves and are refined by neighbours-of-neighbours joins: around each
node, the vectors that it lists and that list it are compared with one another,
and every pair better than the end of a list enters it, until the lists hardly
change.  Nodes around which no entry is new are not joined again, as nothing
can come of it.  A list that is saturated, full of links at the threshold, is
enlarged by the links it is offered, to ``ENLARGED`` entries; what lies beyond
is left to the components.  Every comparison also returns a spanning forest of all its pairs at the
threshold, listed or not; these edges link nodes into components.  Later rounds
compare across components only: lists that were full of their own component
search beyond it, with fresh leaves, until no round merges any.  Links are then
counted within components, block against block, so that no group is written out
as pairs.  An audit compares a bounded sample of vectors with all others; while
its recall is below the target, further rounds follow, and after the last round
all vectors are compared across components, block against block.

Vectors travel to where they are compared, a bounded number per call; crowded
leaves, popular nodes and large components are dealt over several calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.arrow import arrow_udf, on_workers
from corpusflow.llm.common import cut, dropped, stored
from corpusflow.llm.components import connected_components
from corpusflow.llm.simhash import hook

#: Neighbours listed, leaf tables per round, pairs a leaf or join offers to each vector.
LISTED, TABLES, OFFERED = 16, 8, 6
#: Entries that a saturated list may grow to.
ENLARGED = 32
#: Vectors in a leaf, popular node's joins and component block; rows per call.
LEAF, CROWD, BLOCK, ROWS_PER_CALL = 128, 64, 2048, 20_000
#: Vectors that the audit compares with all others, the recall it asks for, and most rounds.
AUDITED, RECALL, ROUNDS = 512, 0.99, 4
#: Share of list entries below whose change lists count as settled; links of an audited vector that part its size classes.
SETTLED, SIZES = 0.001, (3, 16)
FOUND = "u long, v long, sim double, tree boolean"


def usable(vec: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    x = F.transform(vec, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce((F.size(vec) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision; the lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sections(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each run of equal keys."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    return iter(np.split(order, np.flatnonzero(change)))


def digest(vec: Column) -> Column:
    """128 bits that name a vector by its components in double precision; 0 and -0 are one."""
    return F.unhex(F.md5(F.transform(vec, lambda v: v.cast("double") + F.lit(0.0)).cast("string").cast("binary")))


def calls(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_CALL))


def leaf_pairs(nodes: DataFrame, n: int, threshold: float, seed: int) -> DataFrame:
    """``FOUND``: the best pairs of each vector within its leaf of every table, and forests (``tree``)."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))

    @arrow_udf("array<bigint>")
    def leaves(vecs: pa.Array) -> pa.Array:
        sizes = np.asarray(pa.compute.list_value_length(vecs))
        out = np.zeros((len(vecs), TABLES), dtype=np.int64)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            x = matrix(vecs.take(pa.array(at)))
            planes = np.random.default_rng([seed, int(dim)]).normal(size=(int(dim), TABLES * bits))
            signs = (x @ planes > 0).reshape(len(at), TABLES, bits)
            out[at] = (signs << np.arange(bits)).sum(axis=2) + (int(dim) << 40)
        return pa.array(list(out), pa.list_(pa.int64()))

    keyed = cut(nodes.select("nid", F.posexplode(leaves(F.col("vec"))).alias("table", "leaf")))
    size = keyed.groupBy("table", "leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * LEAF)
    dealt = keyed.join(size, ["table", "leaf"], "left")
    dealt = dealt.withColumn("_deal", F.pmod(F.xxhash64("nid", "table", F.lit(seed)), F.ceil(F.coalesce("_n", F.lit(1)) / LEAF)))
    placed = dealt.select("nid", F.xxhash64("table", "leaf", "_deal").alias("place")).join(nodes.select("nid", "root", "vec"), "nid")

    def best(t: pa.Table) -> pa.Table:
        nid, root, place = (t[c].to_numpy() for c in ("nid", "root", "place"))
        vec = t["vec"].combine_chunks()
        size = np.asarray(pa.compute.list_value_length(vec))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in sections(place, size):
            if len(at) > 1:
                top_pairs(nid[at], root[at], matrix(vec.take(pa.array(at))), np.full(len(at), -2.0), threshold, out)
        return pairs(out)

    return placed.groupBy(F.pmod("place", F.lit(calls(n * TABLES)))).applyInArrow(best, FOUND)


def top_pairs(nid: np.ndarray, root: np.ndarray, x: np.ndarray, bar: np.ndarray, threshold: float, out: list[list[np.ndarray]]) -> None:
    """For each vector its best ``OFFERED`` partners outside its component that exceed its bar, up to ``ENLARGED`` if they
    are links; the forest of all links."""
    sim = x @ x.T
    sim[root[:, None] == root[None, :]] = -3
    parent = np.arange(len(nid))
    hook(parent, *np.nonzero(sim >= threshold))
    forest(nid, parent, out)
    k = min(ENLARGED if (sim >= threshold).sum(axis=1).max() > OFFERED else OFFERED, len(nid) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sim, best, axis=1)
    if k > OFFERED:
        order = np.argsort(-value, axis=1, kind="stable")
        best, value = (np.take_along_axis(x, order, axis=1) for x in (best, value))
    r, c = np.nonzero((value > bar[:, None]) & (value > -2) & ((np.arange(k) < OFFERED) | (value >= threshold)))
    out[0].append(nid[r])
    out[1].append(nid[best[r, c]])
    out[2].append(value[r, c])
    out[3].append(np.zeros(len(r), dtype=bool))


def forest(nid: np.ndarray, parent: np.ndarray, out: list[list[np.ndarray]]) -> None:
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    for o, x in zip(out, (nid[moved], nid[parent[moved]], np.full(len(moved), np.nan), np.ones(len(moved), dtype=bool))):
        o.append(x)


def pairs(out: list[list[np.ndarray]]) -> pa.Table:
    kinds = (np.int64, np.int64, np.float64, bool)
    return pa.table({n: np.concatenate([np.zeros(0, k), *o]) for n, k, o in zip(("u", "v", "sim", "tree"), kinds, out)})


def best_lists(found: DataFrame, threshold: float) -> DataFrame:
    """The ``LISTED`` best distinct neighbours of each node, in a saturated list up to ``ENLARGED`` links; ``old``: listed before."""
    order = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    return (found.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
            .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= ENLARGED)
            .where((F.col("_r") <= LISTED) | (F.col("sim") >= threshold)).drop("_r"))


def listable(found: DataFrame) -> DataFrame:
    return found.where(~F.col("tree")).select("u", "v", "sim", F.lit(False).alias("old"))


def changes(graph: DataFrame) -> tuple[int, int]:
    """Entries of the lists, and how many of them are new."""
    return tuple(graph.agg(F.count(F.lit(1)), F.count_if(~F.col("old"))).first())


def refine(nodes: DataFrame, graph: DataFrame, entries: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Lists after one neighbours-of-neighbours join around the nodes with new entries, and its forest.

    Saturated lists take links until they hold ``ENLARGED`` entries.
    """
    ends = graph.groupBy("u").agg(F.count(F.lit(1)).alias("_k"), F.min("sim").alias("_low"))
    bar = ends.select(F.col("u").alias("nid"), F.when(F.col("_k") < LISTED, F.lit(-2.0)).when(
        F.col("_low") < threshold, F.col("_low")).when(
        F.col("_k") < ENLARGED, F.lit(float(np.nextafter(threshold, -1)))).otherwise(F.lit(2.0)).alias("bar"))
    active = graph.where(~F.col("old")).select(F.explode(F.array("u", "v")).alias("w")).distinct()
    # around w: its own list in every share, those that list it in one share each
    popular = graph.groupBy(F.col("v").alias("w")).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("_shares"))
    listed = graph.select(F.col("u").alias("w"), F.col("v").alias("nid")).join(popular, "w", "left").select(
        "w", "nid", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)).alias("share"))
    listing = graph.select(F.col("v").alias("w"), F.col("u").alias("nid")).join(popular, "w").select(
        "w", "nid", F.pmod(F.xxhash64("nid"), F.col("_shares")).cast("int").alias("share"))
    around = listed.unionByName(listing).distinct().join(active, "w", "left_semi").join(nodes.select("nid", "root", "vec").join(bar, "nid", "left"), "nid")

    def join(t: pa.Table) -> pa.Table:
        nid, root, w, share = (t[c].to_numpy() for c in ("nid", "root", "w", "share"))
        bars = pa.compute.fill_null(t["bar"], -2.0).to_numpy()
        vec = t["vec"].combine_chunks()
        size = np.asarray(pa.compute.list_value_length(vec))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in sections(size, w, share):
            if len(at) > 1:
                top_pairs(nid[at], root[at], matrix(vec.take(pa.array(at))), bars[at], threshold, out)
        return pairs(out)

    found = cut(around.groupBy(F.pmod(F.xxhash64("w", "share"), F.lit(calls(3 * entries)))).applyInArrow(join, FOUND))
    offers = listable(found)
    both = offers.unionByName(offers.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "old"))
    lists = best_lists(graph.withColumn("old", F.lit(True)).unionByName(both), threshold)
    return stored(lists, "lists"), found.where("tree").select("u", "v")


def all_pairs(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(u, v): a forest of all links across components, every block of vectors against every other."""
    m = max(1, -(-n // BLOCK))
    rows = nodes.select("nid", "root", "vec", F.pmod(F.xxhash64("nid"), F.lit(m)).alias("_c")).withColumn(
        "_o", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    rows = rows.select("nid", "root", "vec", F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        nid, root = t["nid"].to_numpy(), t["root"].to_numpy()
        vec = t["vec"].combine_chunks()
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in sections(np.asarray(pa.compute.list_value_length(vec))):
            x, parent = matrix(vec.take(pa.array(at))), np.arange(len(at))
            for s in range(0, len(at), 512):
                r, c = np.nonzero((x[s:s + 512] @ x.T >= threshold) & (root[at[s:s + 512], None] != root[None, at]))
                hook(parent, r + s, c)
            forest(nid[at], parent, out)
        return pairs(out)

    return rows.groupBy("i", "j").applyInArrow(compare, FOUND).select("u", "v")


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(nid, n, other): vectors at the threshold within the component, copies and itself counted, and distinct ones.

    ``members``: nid, root, copies, vec.  A component of more than ``BLOCK``
    nodes is compared block against block in separate calls.
    """
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("_k"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_m"))
    travelling = size.agg(F.sum(F.col("_k") * (2 * F.col("_m") - 1))).first()[0] or 0  # rows as they are replicated below
    size = size.drop("_k")
    rows = members.join(size, "root").withColumn("_c", F.pmod(F.xxhash64("nid"), F.col("_m")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    left = rows.withColumn("_o", others).select("root", F.col("_c").alias("i"), F.col("_o").alias("j"), "nid", "copies", "vec", F.lit(True).alias("counts"))
    right = rows.withColumn("_o", others).select("root", F.col("_o").alias("i"), F.col("_c").alias("j"), "nid", "copies", "vec", F.lit(False).alias("counts"))
    # a small component is one block: its rows serve as both sides
    both = left.unionByName(right.where((F.col("i") != F.col("j"))))

    def count(t: pa.Table) -> pa.Table:
        root, i, j, nid, copies = (t[c].to_numpy() for c in ("root", "i", "j", "nid", "copies"))
        side = t["counts"].to_numpy(zero_copy_only=False) if isinstance(t["counts"], pa.Array) else t["counts"].combine_chunks().to_numpy(zero_copy_only=False)
        vec = t["vec"].combine_chunks()
        ids, ns, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in sections(root, i, j):
            mine = at[side[at]]
            theirs = mine if i[at[0]] == j[at[0]] else at[~side[at]]
            if len(mine) and len(theirs):
                y, weight = matrix(vec.take(pa.array(theirs))), copies[theirs]
                for s in range(0, len(mine), 512):
                    some = mine[s:s + 512]
                    near = matrix(vec.take(pa.array(some))) @ y.T >= threshold
                    ids.append(nid[some])
                    ns.append(near @ weight)
                    others.append(near.sum(axis=1))
        return pa.table({"nid": np.concatenate(ids), "n": np.concatenate(ns).astype(np.int64), "other": np.concatenate(others).astype(np.int64)})

    return both.groupBy(F.pmod(F.xxhash64("root", "i", "j"), F.lit(calls(travelling)))).applyInArrow(
        count, "nid long, n long, other long").groupBy("nid").agg(F.sum("n").alias("n"), (F.sum("other") - 1).alias("other"))


def audit(nodes: DataFrame, counted: DataFrame, threshold: float) -> float:
    """Recall over a bounded sample of vectors, found by comparing it with every vector.

    Links are those between different vectors; copies are found by construction
    and do not count.  The result is the smallest of the share of all links and,
    for vectors with few, some and many links (``SIZES``), the mean share of a
    vector's links.
    """
    sample = nodes.orderBy(F.xxhash64(F.lit(5), "nid"), "nid").limit(AUDITED)
    rows = sample.join(counted, "nid", "left").select("nid", "vec", F.coalesce("other", F.lit(0)).alias("other")).collect()
    if not rows:
        return 1.0
    by_size: dict[int, list] = {}
    for r in rows:  # at most AUDITED rows
        by_size.setdefault(len(r["vec"]), []).append(r)
    queries = {d: (np.array([r["nid"] for r in rs]), matrix(pa.array([r["vec"] for r in rs], pa.list_(pa.float64())))) for d, rs in by_size.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros(len(q[0]), dtype=np.int64) for d, q in queries.items()}
        for batch in batches:
            vec = batch.column("vec")
            size = np.asarray(pa.compute.list_value_length(vec))
            for d, (_, q) in queries.items():
                at = np.flatnonzero(size == d)
                for s in range(0, len(at), 4096):
                    some = at[s:s + 4096]
                    sums[d] += (q @ matrix(vec.take(pa.array(some))).T >= threshold).sum(axis=1)
        for d, (nid, _) in queries.items():
            yield pa.RecordBatch.from_arrays([pa.array(nid), pa.array(sums[d])], names=["nid", "n"])

    true = nodes.select("vec").mapInArrow(compare, "nid long, n long").groupBy("nid").agg(F.sum("n").alias("n"))
    truth = {r["nid"]: r["n"] - 1 for r in true.collect()}
    links = np.array([(min(r["other"], truth[r["nid"]]), truth[r["nid"]]) for r in rows if truth[r["nid"]] > 0])
    if not len(links):
        return 1.0
    share, kind = links[:, 0] / links[:, 1], np.searchsorted(SIZES, links[:, 1])
    return float(min(links[:, 0].sum() / links[:, 1].sum(), *(share[kind == k].mean() for k in np.unique(kind))))


def near_duplicates(table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
                    recall: float = RECALL, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept`` and the last ``audit_recall``.

    ``n_links`` counts the other vectors with cosine >= ``threshold`` (copies
    included), ``component_id`` is the smallest id that links reach.  Null,
    empty, zero and non-finite vectors link with nothing, and vectors of
    different lengths never link.  A row with a null id links like any other,
    never names a component and is not kept.  Repeated rows are copies of each
    other.  Other columns are not read; an empty table gives no rows.
    """
    on_workers()
    rows = table.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("vec"))
    good = rows.where(usable(F.col("vec"))).withColumn("key", digest(F.col("vec")))
    nodes = cut(good.groupBy("key", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
                .withColumn("nid", F.monotonically_increasing_id()))  # fixed by the checkpoint
    n = nodes.count()
    graph, roots, measured = None, None, 1.0
    for k in range(rounds + 1):
        rooted = nodes.withColumn("root", F.col("nid")) if roots is None else nodes.join(
            roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
        if k < rounds:
            found = cut(leaf_pairs(rooted, n, threshold, seed + k))
            trees, lists = found.where("tree").select("u", "v"), listable(found)
            if graph is not None:
                # lists go on without what is now in the same component; what a component's members list is
                # joined once more, as others may come first now
                linked = roots.select(F.col("node").alias("nid"), F.lit(False).alias("single"))
                ends = rooted.select("nid", "root").join(linked, "nid", "left").select("nid", "root", F.coalesce("single", F.lit(True)))
                lists = lists.unionByName(graph.join(ends.toDF("u", "_ru", "_su"), "u").join(ends.toDF("v", "_rv", "_sv"), "v").where(
                    F.col("_ru") != F.col("_rv")).select("u", "v", "sim", (F.col("old") & F.col("_su") & F.col("_sv")).alias("old")))
            before, graph = graph, stored(best_lists(lists, threshold), "lists")
            if before is not None:
                dropped(before)
            entries, changed = changes(graph)
            while changed:
                before, (graph, more) = graph, refine(rooted, graph, entries, threshold)
                dropped(before)
                trees = trees.unionByName(more)
                entries, changed = changes(graph)
                if changed <= SETTLED * n * LISTED:
                    break
        else:  # not settled by the search
            trees = all_pairs(rooted, n, threshold)
        if roots is not None:
            trees = cut(trees)
            merges = not trees.isEmpty()
            trees = trees.unionByName(roots.toDF("u", "v"))
        else:
            merges = True
        if merges:
            roots = cut(connected_components(trees, "u", "v"))
            if k < min(rounds, n - 1):
                continue  # the next round looks for links between the components
        members = cut(roots.withColumnRenamed("node", "nid").join(nodes.select("nid", "copies", "vec", "first"), "nid"))
        counted = cut(link_counts(members.select("nid", "root", "copies", "vec"), threshold))
        links = members.select("nid", "root", "first").join(counted, "nid")
        measured = audit(nodes, counted, threshold)
        if measured >= recall:
            break
    if graph is not None:
        dropped(graph)
    lowest = links.groupBy("root").agg(F.min("first").alias("lowest"))
    named = links.join(lowest, "root").select("nid", "n", "lowest")
    each = nodes.join(named, "nid", "left").select(
        F.col("key"), F.lit(True).alias("_v"), (F.coalesce("n", "copies") - 1).alias("n_links"), F.coalesce("lowest", "first").alias("component_id"))
    found = rows.select("id", F.when(usable(F.col("vec")), digest(F.col("vec"))).alias("key")).join(each, "key", "left")
    own = F.when(F.col("_v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                        own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"),
                        F.lit(float(measured)).alias("audit_recall"))
