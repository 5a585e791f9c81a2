"""Token ids of whole texts from the ids of their units, met once per worker.

A unit is a stretch of text that a tokenizer encodes alike wherever it stands:
a run of letters, of digits or of punctuation marks, as the two pre-tokenizers
here (``spaced`` and not) divide them.  Classes of bytes find the units of a
whole batch in numpy; a stretch between white space that holds anything else
(apostrophes, control characters, special-token strings, characters beyond the
Latin letters) is one unit and goes through the whole tokenizer.  Units are
interned per batch (``interning``), a worker keeps the ids of those it has met,
and the ids of all occurrences are gathered at once.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers

from corpusflow.llm.interning import intern, text_buffer

#: Units whose ids a worker keeps, half of them recent; the older half goes when the recent one is full.
KEPT = 300_000
#: Units up to this many bytes are kept; longer ones are encoded each time.
KEPT_BYTES = 64

SPACE, LETTER, DIGIT, MARK, ODD = range(5)
CLASS = np.full(256, ODD, dtype=np.uint8)
CLASS[33:127] = MARK
CLASS[[9, 10, 12, 13, 32]] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[39] = ODD  # contractions
#: Two bytes of UTF-8 that are a Latin letter up to U+024F, as one number.  Left out are the two
#: signs of arithmetic among them and the capital whose small form is two characters.
LATIN = np.zeros(1 << 16, dtype=bool)
LATIN[[int.from_bytes(chr(c).encode()) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7, 0x130)]] = True

STEM = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
#: A byte as the letter that byte-level vocabularies show for it: itself where it is a sign, else one from U+0100 on.
SIGNS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in SIGNS} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SIGNS)}
#: White space beyond ASCII, and signs that some Unicode versions count as it.
BLANKS = "\v\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANK_LEAD = np.zeros(1 << 16, dtype=bool)
BLANK_LEAD[[int.from_bytes(c.encode()[:2]) for c in BLANKS[5:]]] = True


def blank(c: str) -> bool:
    return c.isspace() or c in BLANKS


class UnitEncoder:
    """``spaced``: byte-level pre-tokens that take one space before them, as they are written;
    else pre-tokens of lower-cased text whose white space is dropped."""

    def __init__(self, path: str, spaced: bool, encode_special_tokens: bool = False):
        self.tokenizer, self.spaced = tokenizers.Tokenizer.from_file(path), spaced
        self.tokenizer.encode_special_tokens = encode_special_tokens
        self.model, self.size = self.tokenizer.model, self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(not t.startswith("<|") or any(c.isspace() for c in t) for t in self.special):
            raise ValueError("special tokens that do not begin with <| or hold white space")
        self.met: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def shown(self, unit: bytes) -> str | None:
        """A unit that is one pre-token of Latin letters, as the library's model takes it: bytes shown as letters."""
        space = self.spaced and unit[:1] == b" "
        if unit[space:].isalpha():  # letters of ASCII
            return "Ġ" + unit[1:].decode() if space else unit.decode()
        letters = unit[space:].decode()
        if not STEM.fullmatch(letters):
            return None
        letters = (letters if self.spaced else letters.lower()).encode().decode("latin-1").translate(BYTE_LETTERS)
        return "Ġ" + letters if space else letters

    def learn(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit, 32 bits each."""
        if len(self.met) > KEPT // 2:  # what is still in use comes back from the older half
            self.met, self.older = {}, self.met
        met, older, model, rest = self.met, self.older, self.model, []
        out = list(map(met.get, units))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            unit = units[i]
            ids = older.get(unit)
            if ids is None:
                one = self.shown(unit)
                if one is None:
                    rest.append(i)
                    continue
                ids = array("I", [t.id for t in model.tokenize(one)]).tobytes()
            out[i] = ids
            if len(unit) <= KEPT_BYTES:
                met[unit] = ids
        for i, ids in zip(rest, self.whole([units[i].decode() for i in rest])):
            out[i] = ids
            if len(units[i]) <= KEPT_BYTES:
                met[units[i]] = ids
        return out

    def classes(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each byte, where all of an odd stretch is odd, and whether a text begins there."""
        n = int(offsets[-1])
        cls = CLASS[buf[:n]]
        lead = np.flatnonzero(buf[:n] >= 0xC3)
        lead = lead[LATIN[buf[lead].astype(np.int32) << 8 | buf[lead + 1]]]
        cls[lead] = cls[lead + 1] = LETTER
        bar = np.flatnonzero(buf[:n] == ord("|"))
        cls[bar[(bar > 0) & (buf[bar - 1] == ord("<"))]] = ODD
        begins = np.zeros(n + 1, dtype=bool)
        begins[offsets] = True
        odd = np.flatnonzero(cls == ODD)
        if odd.size:
            dark = cls != SPACE
            first = dark.copy()
            first[1:] &= ~dark[:-1] | begins[1:n]
            starts = np.flatnonzero(first)
            last = dark.copy()
            last[:-1] &= ~dark[1:] | begins[1:n]
            ends = np.flatnonzero(last) + 1
            some = np.unique(np.searchsorted(starts, odd, side="right") - 1)
            change = np.zeros(n + 1, dtype=np.int8)
            change[starts[some]] += 1
            np.add.at(change, ends[some], -1)
            cls[np.cumsum(change[:n], dtype=np.int8) > 0] = ODD
        return cls, begins

    def units(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of every unit, in order."""
        n = int(offsets[-1])
        cls, begins = self.classes(buf, offsets)
        change = begins[:n].copy()
        change[1:] |= cls[1:] != cls[:-1]
        if not self.spaced:
            small = np.flatnonzero((cls == LETTER) & (buf[:n] >= 65) & (buf[:n] <= 90))
            buf[small] += 32
            starts = np.flatnonzero(change)
            lengths = np.diff(np.append(starts, n))
            dark = cls[starts] != SPACE
            return starts[dark], lengths[dark]
        # the last of a stretch of white space stands alone, and a space belongs to what follows it
        light = cls == SPACE
        last = np.flatnonzero(light[:-1] & ~light[1:] & ~begins[1:n]) if n else np.zeros(0, np.int64)
        change[last] = True
        change[last[buf[last] == 32] + 1] = False
        starts = np.flatnonzero(change)
        return starts, np.diff(np.append(starts, n))

    def uneven(self, buf: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts where other white space than ASCII's usual begins or ends a stretch: they have no such units."""
        n = int(offsets[-1])
        lead = np.flatnonzero(buf[:n] >= 0xC2)
        lead = lead[BLANK_LEAD[buf[lead].astype(np.int32) << 8 | buf[lead + 1]]]
        low = np.flatnonzero((buf[:n] == 11) | (buf[:n] >= 28) & (buf[:n] < 32))
        texts = []
        for i in np.unique(np.searchsorted(offsets, np.concatenate((lead, low)), side="right") - 1).tolist():
            pieces = re.split("[\t\n\f\r ]+", buf[offsets[i]:offsets[i + 1]].tobytes().decode())
            if any(p and (blank(p[0]) or blank(p[-1])) for p in pieces):
                texts.append(i)
        return texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null as empty) in order, and the number of each text's ids."""
        buf, offsets = text_buffer(texts)
        uneven = self.uneven(buf, offsets) if self.spaced else ()
        if uneven:
            return self._by_text(texts, set(uneven))
        starts, lengths = self.units(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        slot, standing = intern(buf, starts, lengths)
        data = buf.tobytes()
        pool = self.learn([data[a:b] for a, b in zip(starts[standing].tolist(), (starts + lengths)[standing].tolist())])
        size = np.fromiter(map(len, pool), dtype=np.int64, count=len(pool)) // 4
        first = np.cumsum(size) - size
        n = size[slot]
        upto = np.cumsum(n)
        ids = np.frombuffer(b"".join(pool), np.uint32)[np.repeat(first[slot] - (upto - n), n) + np.arange(int(upto[-1]))]
        edges = np.concatenate(([0], upto))[np.searchsorted(starts, offsets)]
        return ids, np.diff(edges)

    def _by_text(self, texts: pa.Array, uneven: set[int]) -> tuple[np.ndarray, np.ndarray]:
        even = [i for i in range(len(texts)) if i not in uneven]
        ids, n = self.encode(texts.take(pa.array(even, pa.int64())))
        parts = dict(zip(even, np.split(ids, np.cumsum(n)[:-1]) if even else ()))
        parts |= dict(zip(sorted(uneven), (np.frombuffer(x, np.uint32) for x in self.whole([texts[i].as_py() for i in sorted(uneven)]))))
        found = [parts[i] for i in range(len(texts))]
        return np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)


@lru_cache(maxsize=4)
def unit_encoder(path: str, spaced: bool, encode_special_tokens: bool = False) -> UnitEncoder:
    return UnitEncoder(path, spaced, encode_special_tokens)
