"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the
piece they make, leftmost first among equals, and merges until no pair makes a
piece.  Long stretches use a heap with lazily dropped entries; ordinary words
run through the same agenda many at a time, one numpy row per word whose best
open pair is merged in every step.

A piece holds the space mark only at its front, so a text falls apart into
stretches (space marks with what follows up to the next) that are encoded on
their own.  Each worker keeps the stretches it has met, up to a fixed number;
new ones are encoded by the agenda and checked against the library, a batch at
a time, before use.  Whole texts are then put together, decoded by the library,
and compared with what went in.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from sentencepiece import sentencepiece_model_pb2

from corpusflow.llm.arrow import arrow_udf, parts, struct

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Marks that often close a word.
MARKS = ",.;:!?*$%&#|"
#: Stretches up to this many symbols are merged in numpy, longer ones on a heap.
SHORT = 24
#: Stretches that a worker keeps, half of them recent; the older half goes when the recent one is full.
KEPT = 300_000
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces and scores of a model file, and the pairs that merge."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        norm = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap
                or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces):
            raise ValueError("a merge-type vocabulary with byte fallback and no normalisation is needed")
        if any(p.type not in (NORMAL, UNKNOWN, 3, BYTE) or SPACE in p.piece.lstrip(SPACE) for p in model.pieces):
            raise ValueError("pieces with inner space marks and user-defined or unused pieces are not handled")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # order of merging: higher score first; equal scores tie
        scores = sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True)
        place = {s: i for i, s in enumerate(scores)}
        self.rank = np.full(len(self.pieces) + 1, _NONE, dtype=np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                self.rank[i] = place[p.score]
        pairs = sorted((self.ids[w[:k]] << 32 | self.ids[w[k:]], i) for w, i in self.ids.items()
                       for k in range(1, len(w)) if w[:k] in self.ids and w[k:] in self.ids)
        self.merged = dict(pairs)
        # open-addressed table of the pairs, for lookups by whole arrays
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        for key, value in pairs:
            at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.keys[at] != -1:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, value
        # no merge spans two neighbours that no piece holds side by side
        self.bigrams = {w[i:i + 2] for w in self.ids for i in range(len(w) - 1)}
        self.newline_apart = not any("\n" in b for b in self.bigrams)
        self.symbol = -np.arange(0x110000, dtype=np.int32) - 1
        for w, i in self.ids.items():
            if len(w) == 1:
                self.symbol[ord(w)] = i

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that each pair of symbols makes, or -1."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), -1, dtype=np.int32)
        out[(left < 0) | (right < 0)] = -2
        open_ = np.flatnonzero(out == -1)
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        out[out == -2] = -1
        return out

    def finish(self, symbols: list[int]) -> list[int]:
        """Ids of merged symbols; symbols below 0 stand for a character outside the pieces."""
        if min(symbols) >= 0:
            return symbols
        out = []
        for s in symbols:
            out += [s] if s >= 0 else [self.bytes[b] for b in chr(-s - 1).encode("utf-8")]
        return out

    def symbols(self, text: str) -> np.ndarray:
        """Ids of single characters; -1 - code point for one that is no piece."""
        return self.symbol[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]

    def by_heap(self, stretch: str) -> list[int]:
        """Agenda of adjacent pairs as a heap of (rank, position); stale entries are dropped when met."""
        sym = self.symbols(stretch).tolist()
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            piece = self.merged.get(sym[a] << 32 | sym[b]) if sym[a] >= 0 and sym[b] >= 0 else None
            if piece is not None:
                heapq.heappush(agenda, (int(self.rank[piece]), a, b, sym[a], sym[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = _NONE
        while agenda:
            _, a, b, was_a, was_b = heapq.heappop(agenda)
            if sym[a] != was_a or sym[b] != was_b or right[a] != b:
                continue
            sym[a], sym[b] = self.merged[was_a << 32 | was_b], gone
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
                offer(a, right[a])
            if left[a] >= 0:
                offer(left[a], a)
        return self.finish([s for s in sym if s != gone])

    def by_rows(self, stretches: list[str]) -> list[bytes]:
        """The same agenda for many short stretches: each step merges every row's best open pair."""
        rows, width = len(stretches), max(map(len, stretches))
        sym = np.full((rows, width + 1), -_NONE, dtype=np.int32)
        size = np.array([len(s) for s in stretches])
        sym[np.arange(width + 1)[None, :] < size[:, None]] = self.symbols("".join(stretches))
        make = self.pair(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(rows, width)
        best = np.where(make >= 0, self.rank[make], _NONE)
        live = np.arange(rows)
        done_sym, done_size = sym.copy(), size.copy()
        column = np.arange(width + 1)
        while True:
            at = best.argmin(axis=1)  # the leftmost among equals
            go = best[np.arange(len(live)), at] != _NONE
            if not go.all():
                stop = ~go
                done_sym[live[stop]], done_size[live[stop]] = sym[stop], size[stop]
                live, sym, size, make, best, at = live[go], sym[go], size[go], make[go], best[go], at[go]
            if not len(live):
                break
            here = np.arange(len(live))
            sym[here, at] = make[here, at]
            # close the gap that the merged pair leaves
            source = np.minimum(column[None, :] + (column[None, :] > at[:, None]), width)
            sym = np.take_along_axis(sym, source, axis=1)
            sym[:, width] = -_NONE
            make = np.take_along_axis(make, source[:, :width].clip(max=width - 1), axis=1)
            best = np.take_along_axis(best, source[:, :width].clip(max=width - 1), axis=1)
            make[:, width - 1], best[:, width - 1] = -1, _NONE
            size = size - 1
            for side in (at - 1, at):  # the new symbol's pairs
                ok = side >= 0
                r, c = here[ok], side[ok]
                piece = self.pair(sym[r, c], sym[r, c + 1])
                make[r, c] = piece
                best[r, c] = np.where(piece >= 0, self.rank[piece], _NONE)
        filled = column[None, :] < done_size[:, None]
        flat = done_sym[filled].astype("<u4").tobytes()
        ends = (4 * np.cumsum(done_size)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(((done_sym < 0) & filled).any(axis=1)):
            out[i] = array("I", self.finish(done_sym[i, :done_size[i]].tolist())).tobytes()
        return out

    def agenda(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch as little-endian unsigned 32-bit integers."""
        out = [b""] * len(stretches)
        size = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
        order = np.argsort(size, kind="stable")
        short = order[(size[order] > 0) & (size[order] <= SHORT)].tolist()
        for k in range(0, len(short), 8192):
            some = short[k:k + 8192]
            for i, ids in zip(some, self.by_rows([stretches[i] for i in some])):
                out[i] = ids
        for i in np.flatnonzero(size > SHORT):
            out[i] = array("I", self.by_heap(stretches[i])).tobytes()
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids by the piece tables, with the first space mark as a space."""
        if not self.byte_of.keys() & set(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


def split_stretches(text: str) -> list[str]:
    """Stretches of a text without their first space mark: runs of further marks and what follows."""
    words = text.replace(SPACE, " ").split(" ")
    if "" not in words[:-1]:
        return words
    out, run = [], 0
    for w in words[:-1]:
        if w:
            out.append(SPACE * run + w)
            run = 0
        else:
            run += 1
    out.append(SPACE * run + words[-1])
    return out


class Encoder:
    """A worker's vocabulary and the stretches it has met, with their ids as bytes."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.met: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self.corrected: set[str] = set()  # stretches that the library encodes otherwise; none is known

    def units(self, stretch: str) -> list[str]:
        """The stretch in parts that no piece spans: apart at newlines, and before closing marks."""
        out: list[str] = []
        vocabulary = self.vocabulary
        for k, line in enumerate(stretch.split("\n") if vocabulary.newline_apart else [stretch]):
            if k:
                out.append("\n")
            core = line.rstrip(MARKS)
            if core and core != line and line[len(core) - 1:len(core) + 1] not in vocabulary.bigrams:
                out += [core, line[len(core):]]
            elif line or not k:
                out.append(line)
        return out

    def learn(self, words: set[str]) -> None:
        """Encode new stretches by the agenda and check them against the library."""
        if len(self.met) > KEPT // 2:  # what is still in use comes back from the older half
            self.met, self.older = {}, self.met
        if len(self.inner) > KEPT // 8:
            self.inner = {}
        met, inner = self.met, self.inner
        new = words - met.keys()
        known = new & self.older.keys()
        met.update((w, self.older[w]) for w in known)
        new -= known
        mixed = {w: self.units(w) for w in new if not w.isalpha()}
        # first units follow a space mark, the others nothing
        first = list((new - mixed.keys()).union(u[0] for u in mixed.values()) - met.keys())
        later = list({x for u in mixed.values() for x in u[1:]} - inner.keys())
        for at in range(0, len(first), 50_000):
            some = first[at:at + 50_000]
            met.update(zip(some, self.vocabulary.agenda([SPACE + w for w in some])))
        inner.update(zip(later, self.vocabulary.agenda(later)))
        for w, u in mixed.items():
            if len(u) > 1:
                met[w] = met[u[0]] + b"".join([inner[x] for x in u[1:]])
        new.discard("")  # the library gives no ids at all for an empty text
        names = list(new)
        for at in range(0, len(names), 50_000):
            some = names[at:at + 50_000]
            library = self.vocabulary.library.encode([w.replace(SPACE, " ") for w in some], num_threads=1)
            sizes = np.fromiter(map(len, library), dtype=np.int64, count=len(some))
            flat = np.fromiter(chain.from_iterable(library), dtype="<u4", count=int(sizes.sum()))
            own = [met[w] for w in some]
            if flat.tobytes() != b"".join(own) or [4 * n for n in sizes.tolist()] != [len(x) for x in own]:
                for w, ids in zip(some, library):  # the library's ids hold
                    b = np.array(ids, dtype="<u4").tobytes()
                    if met[w] != b:
                        met[w] = b
                        self.corrected.add(w)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without begin and end."""
        return [ids for ids, _ in self.encode_noting(texts)]

    def encode_noting(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """``encode``, and whether the library had to encode some stretch of the text."""
        split = [split_stretches(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        met, corrected = self.met, self.corrected
        return [(b"".join([met[w] for w in words]), bool(corrected) and not corrected.isdisjoint(words)) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; it lives as long as the worker does."""
    return Encoder(path)


def encode_decode(text: Column, model: str, digests: bool = True) -> Column:
    """Struct of ``n_tokens``, ``ids`` (binary or, with ``digests``, its SHA-256), ``decoded`` (likewise) and ``by_library``.

    Ids carry begin and end.  A null or empty text is the two of them alone and
    decodes to an empty text; a text that holds the space mark itself decodes
    with plain spaces there, as the library does.  Where the agenda's ids differ
    from the library's, or a text does not decode to itself, the library's own
    encoding is returned and ``by_library`` is true.  ``model`` is a path that
    every executor can read.
    """
    kind = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string, by_library: boolean>" if digests else \
        "struct<n_tokens: bigint, ids: binary, decoded: string, by_library: boolean>"

    @arrow_udf(kind)
    def of(texts: pa.Array) -> pa.Array:
        e = encoder(model)
        library = e.vocabulary.library
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (library.bos_id(), library.eos_id()))
        count, all_ids, all_text, helped = [], [], [], []
        for some in parts(texts):
            for t, (ids, noted) in zip(some, e.encode_noting(some)):
                ids = begin + ids + end
                decoded = library.decode(np.frombuffer(ids, dtype="<u4").tolist())
                if decoded != t.replace(SPACE, " "):
                    own = library.encode(t)
                    ids, decoded, noted = begin + np.array(own, dtype="<u4").tobytes() + end, library.decode(own), True
                helped.append(noted)
                count.append(len(ids) // 4)
                all_ids.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                all_text.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest() if digests else decoded)
        names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
        return struct({"n_tokens": pa.array(count, pa.int64()),
                       names[0]: pa.array(all_ids, pa.string() if digests else pa.binary()),
                       names[1]: pa.array(all_text, pa.string()), "by_library": pa.array(helped, pa.bool_())})

    return of(text)
