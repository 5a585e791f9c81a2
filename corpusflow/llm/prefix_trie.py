"""The trie of conversation prefixes, from sorted conversations and range minima.

A conversation is a row of turns, each a digest of its role and text; the
digests one after another are its key.  Rows sorted by key put the conversations
that share a prefix side by side, and the number of turns that neighbours share
(their LCP) says everything about the trie: the prefix of the first ``d`` turns
of a row stands in all rows around it up to the nearest LCP below ``d``.

Sorted rows are taken in blocks.  A block builds sparse tables of minima over
its LCPs and ids; every candidate prefix then finds its left and right extent by
itself, by binary search over the table, and its member interval gives its
counts, its smallest member and, over the block's prefixes in their order, the
sums over its subtree.  A prefix that goes on in the next block or came from the
one before adds up what the blocks say of it: a child, a leaf and a node's own
share count in one block only, which the LCPs at the block's edges decide.  Few
prefixes are open in this way, those of a block's first and last row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.arrow import on_workers
from corpusflow.llm.common import cut, stored, text_or_empty, word_count

#: Bytes of a turn's digest.
TURN = 16
#: Rows and turns of a block.
BLOCK_ROWS, BLOCK_TURNS = 1 << 15, 1 << 18

PART = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string, block long, at long, parent_at long, node binary, ends binary")


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """128 bits that stand for a turn's role and text, null as empty."""
    r, t = text_or_empty(role), text_or_empty(text)
    return F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary")))


def rebuilt(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            every: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c as the first h turns of conversation ``c - c % every``, then its own after its first h,
    where h is the unsigned crc32 of the decimal c modulo ``most``: ``conv_id``, ``key`` (digests of its turns one
    after another) and ``words`` (of each turn's text).

    Turns are in order of their number, null first, then of role and digest.  Rows without a conversation id belong
    to none and are left out.  A conversation is one row: 16 bytes and a number for each turn.
    """
    c = F.col(f"`{conv_id}`").cast("bigint")
    rows = turns.where(c.isNotNull()).select(
        c.alias("conv_id"), (c - c % every).alias("_base"),
        F.struct(F.col(f"`{turn}`").alias("turn"), text_or_empty(F.col(f"`{role}`")).alias("role"), turn_digest(f"`{role}`", f"`{text}`").alias("digest"),
                 word_count(F.col(f"`{text}`")).cast("int").alias("words")).alias("_t"))
    # dealt by base, so that a conversation and its base meet without another exchange
    whole = rows.repartition("_base").groupBy("_base", "conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_own"))
    # a window holds at most the conversations of one base
    head = F.max(F.when(F.col("conv_id") == F.col("_base"), F.slice("_own", 1, most - 1))).over(Window.partitionBy("_base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    parts = whole.select("conv_id", F.col("_own"), h.alias("_h"), F.coalesce(head, F.slice("_own", 1, 0)).alias("_head"))
    all_turns = F.concat(F.slice("_head", 1, F.col("_h")), F.slice("_own", F.col("_h") + 1, F.greatest(F.size("_own"), F.lit(1))))
    return parts.select("conv_id", all_turns.alias("_all")).select(
        "conv_id", F.unhex(F.array_join(F.transform("_all.digest", F.hex), "")).alias("key"), F.col("_all.words").alias("words"))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Row k: the least of the 2^k values from each place on."""
    rows = [values]
    while len(rows[-1]) > 1 << (len(rows) - 1):
        step = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-step], rows[-1][step:]))
    return rows


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share the first ``depth`` turns of ``row``; ``table`` is of the LCPs of row i and
    i - 1, with the LCP to the row before the block at 0 and to the row after it at the end, so -1 and the number
    of rows stand for what lies outside.
    """
    n = len(table[0])  # rows + 1
    left, right = row.copy(), row.copy()
    for k in range(len(table) - 1, -1, -1):
        step, least = 1 << k, table[k]
        some = np.flatnonzero(left - step >= -1)
        some = some[least[left[some] - step + 1] >= depth[some]]
        left[some] -= step
        some = np.flatnonzero(right + step <= n - 1)
        some = some[least[right[some] + 1] >= depth[some]]
        right[some] += step
    return left, right


def least_between(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    k = np.log2(last - first + 1).astype(np.int64)
    out = np.empty(len(first), dtype=table[0].dtype)
    for level in np.unique(k):
        some = k == level
        out[some] = np.minimum(table[level][first[some]], table[level][last[some] + 1 - (1 << level)])
    return out


class Rows:
    """Rows in order of their keys: ids, keys as rows of two numbers a turn, and words."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = np.asarray(batch.column("conv_id"))
        keys = pa.concat_arrays([batch.column("key").cast(pa.large_binary())])
        ends = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.binary_length(keys), dtype=np.int64))))
        first = int(np.frombuffer(keys.buffers()[1], np.int64)[keys.offset])
        data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[first:first + int(ends[-1])]
        self.turns, self.begin = data.view("<u8").reshape(-1, 2), ends // TURN
        self.words = np.asarray(batch.column("words").flatten(), dtype=np.int64)
        self.depth = np.diff(self.begin)

    def shared(self) -> np.ndarray:
        """LCP of every row with the one before it (none for the first)."""
        n = np.minimum(self.depth[1:], self.depth[:-1])
        if not n.sum():
            return n
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.repeat(self.begin[:-2], n) + within, np.repeat(self.begin[1:-1], n) + within
        differ = (self.turns[a] != self.turns[b]).any(axis=1)
        miss = np.where(differ, within, np.iinfo(np.int64).max)
        out, some = n.copy(), n > 0
        out[some] = np.minimum(n[some], np.minimum.reduceat(miss, (np.cumsum(n) - n)[some]))
        return out


def joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


NO_ENDS = hashlib.sha256(b"").hexdigest()


def block_nodes(rows: Rows, before: int, after: int, block: int) -> pa.RecordBatch:
    """The nodes of a block; ``before`` and ``after`` are the LCPs of its first and last row with the rows outside
    (-1 where there is none)."""
    n, depth = len(rows.ids), rows.depth
    lcp = np.concatenate(([before], rows.shared(), [after])).astype(np.int64)
    table, least_id = sparse_table(lcp), sparse_table(rows.ids)
    # the prefixes in their order: all of the first row, and of each row those that the row before it lacks
    lowest = np.concatenate(([0], lcp[1:n] + 1))
    many = depth - lowest + 1
    first = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(n), many)
    deep = np.arange(int(first[-1])) - np.repeat(first[:-1] - lowest, many)
    left, right = extents(table, row, deep)
    begins, ends = left >= 0, right < n
    left, right = np.maximum(left, 0), np.minimum(right, n - 1)
    n_convs = right - left + 1
    stop = first[right + 1]  # the subtree: from the node itself to here
    words = np.zeros(len(row), dtype=np.int64)
    real = deep > 0
    words[real] = rows.words[rows.begin[row[real]] + deep[real] - 1]

    def below(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(values)))
        return upto[stop] - upto[:-1]

    leaf = ends & (depth[right] == deep)
    saved = (n_convs - begins) * words
    # a parent: the prefix before it in the same row, or where its row's LCP began
    parent = np.arange(len(row)) - 1
    heads = first[1:n][many[1:] > 0]
    some = row[heads]
    home = np.maximum(extents(table, some, lcp[some])[0], 0)
    parent[heads] = first[home] + lcp[some] - lowest[home]
    children = np.bincount(parent[1:][begins[1:]], minlength=len(row))
    smallest = least_between(least_id, left, right)
    closed = begins & ends
    # members that end in a node: the rows with just its turns, from its first on
    ending = depth[left] == deep
    last_equal = np.flatnonzero(np.concatenate(((depth[1:] != depth[:-1]) | (lcp[1:n] != depth[1:]), [True])))
    last = last_equal[np.searchsorted(last_equal, left)]
    hashes = np.where(closed, NO_ENDS, None)
    for i in np.flatnonzero(closed & ending).tolist():
        hashes[i] = hashlib.sha256(joined(rows.ids[left[i]:last[i] + 1])).hexdigest()
    names, texts = np.full(len(row), None), np.full(len(row), None)
    for i, name in zip(np.flatnonzero(~closed).tolist(), prefix_names(rows, row[~closed], deep[~closed])):
        names[i] = name
        if ending[i]:
            texts[i] = joined(rows.ids[left[i]:last[i] + 1])
    open_above = np.concatenate(([False], ~closed[parent[1:]]))
    inner = closed & ~open_above
    inner[0] = False  # the root has no parent
    columns = {"conv_id": smallest, "depth": deep, "parent_conv_id": pa.array(smallest[np.maximum(parent, 0)], mask=~inner), "n_convs": n_convs,
               "n_children": children, "n_leaves": below(leaf), "saved_tokens": below(saved), "ends_sha256": pa.array(hashes, pa.string()),
               "block": np.full(len(row), block), "at": pa.array(np.arange(len(row)), mask=closed), "parent_at": pa.array(parent, mask=~open_above),
               "node": pa.array(names, pa.binary()), "ends": pa.array(texts, pa.binary())}
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in columns.values()], names=list(columns))


def prefix_names(rows: Rows, row: np.ndarray, deep: np.ndarray) -> Iterator[bytes]:
    """128 bits that name a prefix: the digest of its turns' digests.  Depths of a row ascend."""
    data, at, state, done = rows.turns, -1, None, 0
    for r, d in zip(row.tolist(), deep.tolist()):
        if r != at:
            at, state, done = r, hashlib.md5(), 0
        begin = int(rows.begin[r])
        state.update(data[begin + done:begin + d].tobytes())
        done = d
        yield state.copy().digest()


def edge_lcps(ranged: DataFrame) -> DataFrame:
    """``_p``, ``before`` and ``after``: LCPs of a partition's first row with the row before and of its last with the
    row after, -1 where there is none.  One row a partition that has rows."""
    edges = cut(ranged.groupBy("_p").agg(F.min("key").alias("_first"), F.max("key").alias("_last")))
    order = Window.orderBy("_p")  # numbers of partitions only
    numbers = edges.select("_p").select("_p", F.lag("_p").over(order).alias("_q")).where(F.col("_q").isNotNull())
    pairs = numbers.join(edges.select("_p", "_first"), "_p").join(edges.select(F.col("_p").alias("_q"), "_last"), "_q")
    n = F.least(F.octet_length("_first"), F.octet_length("_last"))
    turns = F.when(n > 0, F.sequence(F.lit(0), F.floor(n / TURN).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(turns, lambda i: F.substr(F.col("_first"), i * TURN + 1, F.lit(TURN)) == F.substr(F.col("_last"), i * TURN + 1, F.lit(TURN)))
    miss = F.array_position(same, F.lit(False))
    pairs = cut(pairs.select("_p", "_q", F.when(miss > 0, miss - 1).otherwise(F.floor(n / TURN)).cast("bigint").alias("_lcp")))
    sides = pairs.select("_p", F.col("_lcp").alias("before"), F.lit(None).cast("bigint").alias("after")).unionByName(
        pairs.select(F.col("_q").alias("_p"), F.lit(None).cast("bigint").alias("before"), F.col("_lcp").alias("after")))
    sides = sides.unionByName(edges.select("_p", F.lit(-1).cast("bigint").alias("before"), F.lit(-1).cast("bigint").alias("after")))
    return sides.groupBy("_p").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def blocks(batches: Iterator[pa.RecordBatch], max_rows: int, max_turns: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows together, about ``max_rows`` of them or ``max_turns`` turns."""
    held, rows, turns = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, max_rows):
            part = batch.slice(at, max_rows)
            n = int(pa.compute.sum(pa.compute.list_value_length(part.column("words"))).as_py() or 0)
            if held and (rows + part.num_rows > max_rows or turns + n > max_turns):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, turns = [], 0, 0
            held, rows, turns = [*held, part], rows + part.num_rows, turns + n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // TURN
    x, y = (np.frombuffer(k, "<u8", 2 * n).reshape(-1, 2) for k in (a, b))
    miss = np.flatnonzero((x != y).any(axis=1))
    return int(miss[0]) if miss.size else n


def prefix_trie(convs: DataFrame, *, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie over ``conv_id``, ``key`` and ``words`` (see ``rebuilt``), one row each:

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's, null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (nodes without children in its subtree, itself included), ``saved_tokens`` (over the
    subtree, members but one times words of the node's last turn) and ``ends_sha256`` (of the ids of the members that
    end here, ascending, joined by commas).

    Equal conversations are spread over blocks like any others, by their ids.  An empty table has no node.
    """
    on_workers()

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, block = None, -1, 0

        def of(rows: pa.RecordBatch, after: int) -> pa.RecordBatch:
            return block_nodes(Rows(rows), before, after, (rows.column("_p")[0].as_py() << 32) + block)

        for rows in blocks(batches, block_rows, block_turns):
            if held is None:
                before = rows.column("before")[0].as_py()
            else:
                link = shared_turns(held.column("key")[held.num_rows - 1].as_py(), rows.column("key")[0].as_py())
                yield of(held, link)
                before, block = link, block + 1
            held = rows
        if held is not None:
            yield of(held, held.column("after")[0].as_py())

    # the ranges are sampled, so that their rows are written once and read as they are from then on
    ranged = cut(convs.select("conv_id", "key", "words").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
                 .withColumn("_p", F.spark_partition_id().cast("bigint")))
    sides = edge_lcps(ranged).withColumnRenamed("_p", "_q")
    # three numbers a partition; the join leaves rows where they are, in order
    parts = stored(ranged.join(F.broadcast(sides), F.col("_p") == F.col("_q")).drop("_q").mapInArrow(nodes, PART), "trie")
    open_ = parts.where(F.col("node").isNotNull())
    smallest = open_.groupBy("node").agg(F.min("conv_id").alias("_up"))
    parents = open_.select("block", "at", "node").join(smallest, "node").select("block", F.col("at").alias("parent_at"), "_up")
    under = parts.where(F.col("parent_at").isNotNull()).join(parents, ["block", "parent_at"]).withColumn("parent_conv_id", F.col("_up")).drop("_up")
    top = parts.where(F.col("parent_at").isNull())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    sums = [F.sum(c).alias(c) for c in columns[3:7]]
    pieces = under.where(F.col("node").isNotNull()).unionByName(top.where(F.col("node").isNotNull()).select(*under.columns))
    merged = pieces.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"), *sums)
    merged = merged.join(ends_digests(open_), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    whole = [x.where(F.col("node").isNull()).select(*columns) for x in (top, under)]
    return whole[0].unionByName(whole[1]).unionByName(merged.select(*columns))


def ends_digests(open_: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of open nodes: their blocks' ids pass through the hash in order, one block's at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = {"node": [], "ends_sha256": []}
            for name, ids in zip(batch.column("node"), batch.column("ends")):
                if name.as_py() != node:
                    if node is not None:
                        done["node"].append(node)
                        done["ends_sha256"].append(state.hexdigest())
                    node, state = name.as_py(), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py())
            yield pa.RecordBatch.from_pydict(done, schema=pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]}, schema=pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))

    some = open_.where(F.col("ends").isNotNull()).select("node", "block", "ends")
    return some.repartition("node").sortWithinPartitions("node", "block").select("node", "ends").mapInArrow(digest, "node binary, ends_sha256 string")
