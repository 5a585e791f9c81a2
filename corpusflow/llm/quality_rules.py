"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes over a text's word ids mark every
window that occurs more than once, and the characters of the words inside such
windows are measured against all word characters; lines that repeat an earlier
line are measured likewise.  Word ids come from an exact dictionary and the
hash starts anew in each text, so nothing is shared between texts.  N-gram
coverage takes every place of a repeated window, the first included; line
coverage takes the lines that repeat an earlier one.  A text fails when it breaks a base rule
or when some coverage is above its limit; the one line that a page carries at
its top and again at its foot is excused.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from corpusflow.llm.arrow import arrow_udf, parts, struct

SYMBOLS = b"#*$%&|<>"
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Largest accepted share of word characters inside repeated n-grams, by n, and inside repeated lines.
#: At sf0.1 they lie at twice the 99.9th percentile (7, 6 and 0 %) of texts labelled good, or above.
COVERAGE = {5: 0.15, 7: 0.13, 10: 0.10}
LINES = 0.20
BASE_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 3, 50, 50

_ODD = np.uint64(0x9E3779B97F4A7C15)


def spread(ids: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for every small integer."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(hashes: np.ndarray, valid: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a valid window of ``n`` whose hash occurs at least twice, in any of its places."""
    starts = np.flatnonzero(valid)
    out = np.zeros(len(valid) + 1, dtype=np.int32)
    if len(starts):
        order = np.argsort(hashes[starts], kind="stable")
        h = hashes[starts][order]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), dtype=bool)
        twice[1:] = same
        twice[:-1] |= same
        s = starts[order[twice]]
        np.add.at(out, s, 1)
        np.add.at(out, s + n, -1)
    return np.cumsum(out[:-1]) > 0


def measures(texts: list[str], lengths: list[int]) -> dict[str, np.ndarray]:
    """Base counts and repeated characters of every text."""
    n = len(texts)
    raw = [t.encode("utf-8") for t in texts]
    words = [b.split() for b in raw]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    symbols, n_dup, dup_chars = (np.zeros(n, dtype=np.int64) for _ in range(3))
    word_chars = np.zeros(n, dtype=np.int64)
    for i, b in enumerate(raw):
        symbols[i] = len(b) - len(b.translate(None, SYMBOLS))
        solid = b.translate(None, SPACES)
        word_chars[i] = len(solid) if solid.isascii() else len(solid.decode("utf-8"))
        seen: set[bytes] = set()
        for line in b.split(b"\n"):
            if line in seen:
                n_dup[i] += 1
                dup_chars[i] += len(line.translate(None, SPACES).decode("utf-8"))
            elif line.strip():
                seen.add(line)
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for ws in words for w in ws], dtype=np.int64)
    sizes = np.fromiter((len(w.decode("utf-8")) for w in ids), dtype=np.int64, count=len(ids))
    chars = sizes[flat] if len(flat) else np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(n), counts)
    ends = np.cumsum(counts)
    left = ends[text] - np.arange(len(flat)) if len(flat) else np.zeros(0, dtype=np.int64)  # words from here to the end of the text
    own, salt = spread(flat), spread(text + (1 << 40))
    out = {"n_words": counts, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": n_dup, "dup_line_chars": dup_chars}
    rolling, size = np.zeros(len(flat), dtype=np.uint64), 0
    for k in sorted({BASE_WINDOW, *lengths}):
        while size < k:  # one more word on the right
            ahead = np.zeros(len(flat), dtype=np.uint64)
            ahead[:max(0, len(flat) - size)] = own[size:]
            rolling = rolling * _ODD + ahead
            size += 1
        inside = covered(rolling ^ salt, left >= k, k)
        if k == BASE_WINDOW:
            out["n_repeat_words"] = np.bincount(text[inside], minlength=n).astype(np.int64)
        if k in lengths:
            out[f"repeat_chars_{k}"] = np.bincount(text[inside], weights=chars[inside], minlength=n).astype(np.int64)
    return out


def framed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and words of the line that is a text's first and last and stands nowhere else, 0 if none is."""
    chars, words = (np.zeros(len(texts), dtype=np.int64) for _ in range(2))
    for i, t in enumerate(texts):
        lines = [line for line in t.encode("utf-8").split(b"\n") if line.strip()]
        if len(lines) > 2 and lines[0] == lines[-1] and lines.count(lines[0]) == 2:
            chars[i], words[i] = len(lines[0].translate(None, SPACES).decode("utf-8")), len(lines[0].split())
    return chars, words


def repetition_rules(text: Column, coverage: Mapping[int, float] = COVERAGE, lines: float = LINES) -> Column:
    """Struct of the base counts, ``repeat_chars_<n>``, ``dup_line_chars``, ``base_failed`` and ``kept``.

    Null and empty texts have no words, fail the base rule and are not kept.
    The counts include a line at a text's top and foot, the limits do not.
    Whole texts are measured; a very long text is one unit of work in a batch.
    """
    lengths = sorted(coverage)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
              *(f"repeat_chars_{k}" for k in lengths)]
    kind = ", ".join(f"{c}: bigint" for c in counts)

    @arrow_udf(f"struct<{kind}, base_failed: boolean, kept: boolean>")
    def of(texts: pa.Array) -> pa.Array:
        batches = list(parts(texts))
        found = [measures(some, lengths) for some in batches]
        chars, words = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(([], []), *map(framed, batches)))
        all_ = {c: np.concatenate([np.zeros(0, dtype=np.int64), *(f[c] for f in found)]) for c in counts}
        base = (all_["n_words"] < MIN_WORDS) | (100 * all_["n_repeat_words"] > MAX_REPEAT_PERCENT * all_["n_words"])
        total = all_["word_chars"]
        fine = all_["dup_line_chars"] - chars <= lines * total
        for k in lengths:
            fine &= all_[f"repeat_chars_{k}"] - np.where(words >= k, 2 * chars, 0) <= coverage[k] * total
        return struct({**{c: pa.array(all_[c], pa.int64()) for c in counts}, "base_failed": pa.array(base), "kept": pa.array(~base & fine)})

    return of(text)
