"""SimHash near-dedup by anchor points of a covering code.

Anchors are the codewords of the binary Golay code on 23 fingerprint bits (or
of its product with itself on 46): the code is perfect, so every fingerprint
lies within covering radius 3 of exactly one codeword, its home.  If two
fingerprints differ in at most ``t`` bits, the second lies within ``3 + t`` of
the first one's home.  Every distinct fingerprint is therefore replicated to
all codewords within ``3 + t``, and at each anchor the home fingerprints are
compared with everything that reached it, on all 64 bits.

The codewords near a fingerprint depend only on its syndrome, so they come from
a fixed table of error patterns (145,499 rows for t = 3, by construction) that
is joined on the syndrome.  Copies collapse to one fingerprint first; an anchor
with many home fingerprints is divided into blocks; a block returns a spanning
forest of the links it found instead of all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.arrow import arrow_udf, parts
from corpusflow.llm.common import cut, row_digest, text_or_empty
from corpusflow.llm.components import connected_components
from corpusflow.operators.ranks import bounded_broadcast

CODE_BITS, CHECK_BITS, RADIUS = 23, 11, 3
#: Generator of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Home fingerprints that one block compares, and rows that one task takes.
BLOCK, ROWS_PER_GROUP = 4096, 400_000
#: Beyond so many distinct fingerprints the product of two codes is used.
ONE_CODE_MAX = 1 << 25


def fingerprint(text: str, width: int, seed: int) -> int:
    """64-bit SimHash of the text's word shingles."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1:]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 15):
        spans = zip(starts[i:min(n, i + (1 << 15))].tolist(), last[i:i + (1 << 15)].tolist())
        h = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def simhash(text: Column, width: int = 3, seed: int = 42) -> Column:
    """Fingerprint of a text as a signed long; null counts as empty (0)."""

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = [fingerprint(t, width, seed) for some in parts(texts) for t in some]
        return pa.array(np.array(out, dtype="<u8").view("<i8"), type=pa.int64())

    return of(text)


def remainders() -> list[int]:
    """x^j modulo the generator for every code bit j."""
    out, r = [], 1
    for _ in range(CODE_BITS):
        out.append(r)
        r <<= 1
        if r >> CHECK_BITS:
            r ^= GENERATOR
    return out


def error_patterns(threshold: int) -> pa.Table:
    """All patterns of weight up to ``RADIUS + threshold`` with syndrome and the flips beyond the radius."""
    rem = np.array(remainders())
    pattern, syndrome, flips = [np.zeros(1, int)], [np.zeros(1, int)], [np.zeros(1, int)]
    for w in range(1, RADIUS + threshold + 1):
        at = np.array(list(combinations(range(CODE_BITS), w)))
        pattern.append((1 << at).sum(axis=1))
        syndrome.append(np.bitwise_xor.reduce(rem[at], axis=1))
        flips.append(np.full(len(at), max(0, w - RADIUS)))
    cols = [np.concatenate(x).astype(np.int32) for x in (syndrome, pattern, flips)]
    return pa.table(dict(zip(("_syn", "_pat", "_flips"), cols)))


def syndrome(bits: Column) -> Column:
    out = F.lit(0)
    for i in range(CHECK_BITS):
        mask = sum(1 << j for j, r in enumerate(remainders()) if r >> i & 1)
        out = out + F.bit_count(bits.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << i)
    return out.cast("int")


def near_anchors(fps: DataFrame, threshold: int, codes: int) -> DataFrame:
    """(anchor, home, fp) for every anchor within the covering radius plus ``threshold`` of each ``fp``."""
    patterns = fps.sparkSession.createDataFrame(error_patterns(threshold))
    out = fps.select("fp", F.lit(0).cast("bigint").alias("anchor"), F.lit(0).alias("flips"))
    for k in range(codes):
        bits = F.shiftrightunsigned("fp", k * CODE_BITS).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
        out = out.withColumn("_bits", bits).withColumn("_syn", syndrome(F.col("_bits")))
        out = out.join(F.broadcast(patterns), "_syn").select(  # fixed size: 145,499 rows at threshold 3
            "fp", (F.col("anchor") + F.shiftleft(F.col("_bits").bitwiseXOR(F.col("_pat").cast("bigint")), k * CODE_BITS)).alias("anchor"),
            (F.col("flips") + F.col("_flips")).alias("flips")).where(F.col("flips") <= threshold)
    return out.select("anchor", (F.col("flips") == 0).alias("home"), "fp")


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs (a, b) in a forest of smallest-index roots, in place and fully compressed."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def forest_at_anchors(anchor: np.ndarray, home: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, per anchor, of the links between home rows and all rows."""
    order = np.argsort(anchor, kind="stable")
    anchor, home, fp = anchor[order], home[order], fp[order].view(np.uint64)
    edges = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    left, right = [], []
    for s, e in zip(edges[:-1], edges[1:]):
        at, here = fp[s:e], np.flatnonzero(home[s:e])
        parent, step = np.arange(e - s), max(1, (1 << 21) // (e - s))
        for i in range(0, len(here), step):
            rows = here[i:i + step]
            r, c = np.nonzero(np.bitwise_count(at[rows, None] ^ at[None, :]) <= threshold)
            hook(parent, rows[r], c)
        moved = np.flatnonzero(parent != np.arange(e - s))
        left.append(at[moved].view(np.int64))
        right.append(at[parent[moved]].view(np.int64))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def links(fps: DataFrame, n: int, threshold: int = 3, codes: int | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all of the ``n`` distinct ``fp`` linked at ``threshold`` bits or fewer."""
    codes = codes or (1 if n <= ONE_CODE_MAX else 2)
    rows = near_anchors(fps, threshold, codes)
    homes = near_anchors(fps, 0, codes)  # one row for each fingerprint
    hot = bounded_broadcast(homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
                            .select("anchor", F.ceil(F.col("_n") / block).cast("int").alias("_salts")))
    # a hot anchor becomes blocks (i, j): its home rows of share i meet what reached it of share j
    own = F.pmod(F.xxhash64("fp"), F.col("_salts")).cast("int")
    shares = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    reached = rows.join(hot, "anchor", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1))).withColumn("_i", shares).select(
        "anchor", "_i", own.alias("_j"), "fp", (F.col("home") & (F.col("_i") == own)).alias("home"))
    at_home = homes.join(hot, "anchor").withColumn("_j", shares).where(F.col("_j") != own).select(
        "anchor", own.alias("_i"), "_j", "fp", "home")
    groups = max(1, -(-n * 71 // ROWS_PER_GROUP)) if codes == 1 else max(1, -(-n * 301 // ROWS_PER_GROUP))
    rows = reached.unionByName(at_home).select(
        F.when((F.col("_i") == 0) & (F.col("_j") == 0), F.pmod(F.xxhash64("anchor"), F.lit(groups))).otherwise(
            F.xxhash64("anchor", "_i", "_j")).alias("_g"), "anchor", "_i", "_j", "home", "fp")

    def compare(t: pa.Table) -> pa.Table:
        a, b = forest_at_anchors(t["anchor"].to_numpy(), t["home"].to_numpy(), t["fp"].to_numpy(), threshold)
        return pa.table({"a": a, "b": b})

    return rows.groupBy("_g", "_i", "_j").applyInArrow(compare, "a long, b long")


def fingerprint_groups(prints: DataFrame, *, threshold: int = 3, id_col: str = "id", codes: int | None = None,
                       block: int = BLOCK) -> DataFrame:
    """``prints`` (an id column and ``fp``; a checkpointed or stored table) with ``component_id`` and ``_root``.

    Fingerprints that differ in at most ``threshold`` bits link, and
    ``component_id`` is the smallest id that links reach (null ids never are,
    unless a component has no other).  Ids may be null or repeat in unrelated
    components; ``_root``, a fingerprint, tells these apart.
    """
    fps = cut(prints.groupBy("fp").agg(F.min(id_col).alias("_first")))
    roots = connected_components(links(fps.select("fp"), fps.count(), threshold, codes, block))
    named = roots.join(fps, roots["node"] == fps["fp"]).select("fp", "root", "_first")
    lowest = named.groupBy("root").agg(F.min("_first").alias("_lowest"))
    merged = named.join(lowest, "root").select("fp", "root", "_lowest")
    label = fps.join(merged, "fp", "left").select(
        "fp", F.coalesce("_lowest", "_first").alias("component_id"), F.coalesce("root", "fp").alias("_root"))
    return prints.join(label, "fp")


def simhash_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, threshold: int = 3,
                   seed: int = 42, **options) -> DataFrame:
    """One row per input row: ``id``, ``fp`` (signed long), ``component_id``, ``_root`` and the row's digest ``_d1``, ``_d2``.

    Texts without words have fingerprint 0 and link like any other; null texts
    count as empty.  Repeated rows share a fingerprint and so a component.
    Other columns of ``docs`` are not read.  An empty table gives no rows.
    """
    prints = cut(docs.select(F.col(doc_id).alias("id"), *row_digest(doc_id, text),
                             simhash(text_or_empty(text), width, seed).alias("fp")))
    return fingerprint_groups(prints, threshold=threshold, **options)


def simhash_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each SimHash group: the one with the smallest id (null last)."""
    groups = simhash_groups(docs, doc_id=doc_id, text=text, **options)
    best = groups.groupBy("_root").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "_d1", "_d2")).alias("_best")).select("_best._d1", "_best._d2")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_digest(doc_id, text))
    kept = rows.join(best, ["_d1", "_d2"]).dropDuplicates(["_d1", "_d2"])  # equal rows share a digest
    return kept.select("_row.*")
