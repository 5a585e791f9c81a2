"""Byte strings of a text batch, interned in an open-addressed numpy table.

The strings are spans of one byte buffer, which goes on for at least eight
bytes after the last span.  A span's key is its XXH64 and its place in the
table the key's low bits; of the spans that meet at a free place one becomes
its owner, equal spans (same length and bytes, not only the same key) share it,
and the others go on to the next place.  All spans advance together, so a batch
takes a few passes of whole-array operations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

# fixed values: the primes of XXH64 and the reflected polynomial of CRC-32
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161,
                                             9650029242287828579, 2870177450012600261))
CRC_POLYNOMIAL = np.uint32(0xEDB88320)

PADDING = 8


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ CRC_POLYNOMIAL, t >> np.uint32(1))
    return t


CRC_TABLE = crc_table()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null as empty) with padding, and their offsets (one more than texts)."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    sizes = np.asarray(pa.compute.binary_length(texts), dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.zeros(int(offsets[-1]) + PADDING, dtype=np.uint8)
    if offsets[-1]:
        first = int(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset])
        buf[:-PADDING] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first:first + int(offsets[-1])]
    return buf, offsets


def slices(texts: pa.Array, max_bytes: int) -> Iterator[pa.Array]:
    """The array in slices of about ``max_bytes`` of text; a text is never divided."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64))
    start = done = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield texts.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of marked bytes; a run never passes from one text to the next."""
    n = len(inside)
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before[1:], before[0] = inside[:-1], False
    after[:-1], after[-1] = inside[1:], False
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1 - starts


def _left(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of the buffer on, as little-endian integers."""
    return np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of every span; spans of 32 bytes and more go through the library."""
    eight = _eights(buf)
    h = lengths.astype(np.uint64) + P5
    for k in range(3):
        some = np.flatnonzero(lengths >= 8 * (k + 1))
        if not some.size:
            break
        lane = _left(eight[starts[some] + 8 * k] * P2, 31) * P1
        h[some] = _left(h[some] ^ lane, 27) * P1 + P4
    at = starts + (lengths & ~7)
    some = np.flatnonzero(lengths & 4)
    h[some] = _left(h[some] ^ ((eight[at[some]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at += lengths & 4
    for k in range(3):
        some = np.flatnonzero((lengths & 3) > k)
        h[some] = _left(h[some] ^ (buf[at[some] + k].astype(np.uint64) * P5), 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(lengths >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(buf[starts[i]:starts[i] + lengths[i]])
    return h


def _same(buf: np.ndarray, eight: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans ``a`` and ``b`` hold the same bytes."""
    same = lengths[a] == lengths[b]
    open_ = np.flatnonzero(same & (a != b))
    for k in range(4):
        rest = lengths[a[open_]] - 8 * k
        open_, rest = open_[rest > 0], rest[rest > 0]
        if not open_.size:
            return same
        beyond = ((8 - np.minimum(rest, 8)) * 8).astype(np.uint64)
        differ = ((eight[starts[a[open_]] + 8 * k] ^ eight[starts[b[open_]] + 8 * k]) << beyond) != 0
        same[open_[differ]] = False
        open_ = open_[~differ]
    for i in open_[lengths[a[open_]] > 32].tolist():
        x, y, n = starts[a[i]], starts[b[i]], lengths[a[i]]
        same[i] = np.array_equal(buf[x:x + n], buf[y:y + n])
    return same


def intern(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every span (0, 1, ...) and, for every slot, the span that stands for it."""
    n = len(starts)
    keys = xxh64(buf, starts, lengths) if keys is None else keys
    size = 1 << max(4, (2 * n - 1).bit_length())  # at most half of the places are taken
    table = np.full(size, -1, dtype=np.int32)
    place = (keys & np.uint64(size - 1)).astype(np.int64)
    owner, left, eight = np.zeros(n, dtype=np.int32), np.arange(n, dtype=np.int32), _eights(buf)
    while left.size:
        spot = place[left]
        free = table[spot] < 0
        table[spot[free]] = left[free]
        met = table[spot]
        same = keys[left] == keys[met]
        some = np.flatnonzero(same)
        same[some] = _same(buf, eight, starts, lengths, left[some], met[some])
        owner[left[same]] = met[same]
        left = left[~same]
        place[left] = (place[left] + 1) & (size - 1)
    standing = table[table >= 0]
    slot = np.empty(n, dtype=np.int32)
    slot[standing] = np.arange(len(standing), dtype=np.int32)
    return slot[owner], standing


def crc32(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, long: int = 64) -> np.ndarray:
    """CRC-32 of every span, byte by byte for all spans at once (spans over ``long`` bytes by zlib)."""
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    short = np.searchsorted(-size, -long, side="left")  # the first that is not longer
    for k in range(int(size[short]) if short < len(size) else 0):
        stop = np.searchsorted(-size, -k, side="left")  # spans longer than k
        c = crc[short:stop]
        crc[short:stop] = CRC_TABLE[(c ^ buf[at[short:stop] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(short):
        crc[i] = zlib.crc32(buf[at[i]:at[i] + size[i]])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = crc
    return out
