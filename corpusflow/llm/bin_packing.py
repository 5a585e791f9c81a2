"""Packing documents into as few fixed-length sequences as it can, by minimum bin slack.

A sequence takes the longest piece left and, beside it, the combination of the
pieces left that fills the rest best: a subset sum over their lengths, whose
reachable totals are the bits of one integer.  Which combination is the fullest
depends only on how many pieces there are of each length, and stays the
fullest until one of its lengths runs short, so one solution is repeated that
often.  The plan is thus worked out from the histogram of lengths (at most
``capacity`` numbers, however many documents) and has a bounded number of steps.

Spark does the rest: tasks encode the documents and cut what is too long; a
piece's rank among those of its length is its running number within its task
plus the number of such pieces in earlier tasks; and the plan names, for each
length and range of ranks, the sequences and offsets they go to.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.arrow import arrow_udf, on_workers, struct
from corpusflow.llm.common import cut, stored
from corpusflow.llm.interning import slices
from corpusflow.llm.unit_encoder import unit_encoder

#: Bytes of text that are encoded together.
PART_BYTES = 1 << 20
#: Ranks lie below 2 to this power.
RANK_BITS = 44


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, add ``end_id`` and cut what is longer than ``capacity``.  One row per piece:
    ``doc_id``, ``piece`` (from 0), ``start`` (ids of the document before it), ``length``, ``ids`` (little-endian
    unsigned 32-bit), and the ``part`` that wrote it with ``nth``, its running number there among pieces of its length.

    The rows are written to the shared folder once, so that both numbers stay as they are.  Null and empty texts
    are the end id alone; repeated rows and null ids each make pieces of their own.  Other columns play no part.
    """
    on_workers()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = unit_encoder(tokenizer, spaced=False), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            done = 0
            for some in slices(batch.column("_text"), PART_BYTES):
                ids, n = e.encode(some)
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(doc), dtype=np.int64)
                nth[order] = np.arange(len(doc)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                ends = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(done, len(n)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), data, pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])
                done += len(n)

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return stored(rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary, part int, nth long"), "pieces")


def fullest(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """Of the pieces left, how many of each length fill ``room`` best; longer ones first where several do.

    ``lengths`` ascend.  Bit s of ``reach`` says that some combination adds up to s.
    """
    reach, layers, within = 1, [], (1 << (room + 1)) - 1
    for length in reversed(lengths[:bisect.bisect_right(lengths, room)]):
        many, step = min(left[length], room // length), 1
        while many and not reach >> room:
            take = min(step, many)
            layers.append((length, take, reach))
            reach |= (reach << take * length) & within
            many, step = many - take, 2 * step
        if reach >> room:
            break
    total, picked = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            picked[length] = picked.get(length, 0) + take
            total -= take * length
    return picked


class Plan(NamedTuple):
    """For a range of ranks of one length: where it begins, its first sequence, how many pieces of this length
    a sequence takes, and the offset of the first of them; ``n_sequences`` in all."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    n_sequences: int


def minimum_slack(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan for ``histogram[length]`` pieces of each length."""
    left = {n: c for n, c in histogram.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths lie between 1 and the capacity")
    lengths, used, rows, sequence = sorted(left), dict.fromkeys(left, 0), [], 0
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        picked = fullest(lengths, left, capacity - longest)
        left[longest] += 1
        picked[longest] = picked.get(longest, 0) + 1
        repeats, at = min(left[n] // times for n, times in picked.items()), 0
        for n in sorted(picked, reverse=True):
            rows.append((n << RANK_BITS | used[n], used[n], sequence, picked[n], at))
            at += n * picked[n]
            used[n] += picked[n] * repeats
            left[n] -= picked[n] * repeats
            if not left[n]:
                del lengths[bisect.bisect_left(lengths, n)]
        sequence += repeats
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequence)


def place_in(plan: Plan, length: Column, rank: Column) -> Column:
    """A struct of ``sequence_id`` and ``offset`` for the ``rank``-th piece (from 0) of a length."""

    @arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = (np.asarray(x, dtype=np.int64) for x in (length, rank))
        row = np.searchsorted(plan.key, n << RANK_BITS | r, side="right") - 1
        nth = r - plan.first[row]
        return struct({"sequence_id": pa.array(plan.sequence[row] + nth // plan.times[row]),
                       "offset": pa.array(plan.offset[row] + nth % plan.times[row] * n)})

    return place(length, rank)


def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """The rows of ``pieces`` (which need ``length``, ``part`` and ``nth``) without the last two, and with
    ``sequence_id`` and ``offset``.  Pieces of a sequence follow one another from offset 0 on without gaps.

    The histogram comes to the driver: at most ``capacity`` rows.  An empty table has no sequence.
    """
    counts = cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = minimum_slack(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    earlier = counts.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = pieces.join(earlier, ["part", "length"]).withColumn("_at", place_in(plan, F.col("length"), F.col("_before") + F.col("nth")))
    return placed.select(*[c for c in pieces.columns if c not in ("part", "nth")], "_at.*")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``ids`` of all its pieces in a row, and ``lengths`` of the pieces.

    A group holds at most ``capacity`` ids.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(inside.alias("_p"))
    ids = F.aggregate("_p.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    return rows.select("sequence_id", ids.alias("ids"), F.col("_p.length").alias("lengths"))
