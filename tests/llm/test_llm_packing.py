"""Interning, importance resampling and packing against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
import xxhash

from corpusflow.llm import bin_packing, importance, interning
from corpusflow.llm.bin_packing import fullest, minimum_slack, pack, sequences, token_pieces
from corpusflow.llm.importance import bucket_gains, resample

SF001 = "/root/testdata/sf0.001"
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spans(words):
    buf, offsets = interning.text_buffer(pa.array([w.decode("latin-1") for w in words]))
    return buf, offsets[:-1], np.diff(offsets)


def test_interned_spans_hold_equal_bytes():
    random.seed(1)
    words = [bytes(random.choices(b"ab", k=random.choice([0, 1, 2, 3, 7, 8, 9, 15, 31, 32, 33, 70]))) for _ in range(5000)]
    buf, starts, lengths = spans(words)
    assert [int(h) for h in interning.xxh64(buf, starts, lengths)] == [xxhash.xxh64_intdigest(w) for w in words]
    assert interning.crc32(buf, starts, lengths).tolist() == [zlib.crc32(w) for w in words]
    for keys in (None, np.zeros(len(words), np.uint64), np.array([len(w) for w in words], np.uint64)):  # keys that collide
        some = slice(0, 300) if keys is not None else slice(None)
        slot, standing = interning.intern(buf, starts[some], lengths[some], None if keys is None else keys[some])
        assert len(standing) == len(set(words[some])) and [words[standing[s]] for s in slot] == words[some]


def test_runs_stop_at_text_ends():
    texts = ["ab", None, "", "cd e", " f", "g "]
    buf, offsets = interning.text_buffer(pa.array(texts).slice(0))
    starts, lengths = interning.runs(buf[:offsets[-1]] > 32, offsets)
    assert [buf[a:a + n].tobytes() for a, n in zip(starts, lengths)] == [b"ab", b"cd", b"e", b"f", b"g"]
    parts = list(interning.slices(pa.array(texts), 3))
    assert pa.concat_arrays(parts).to_pylist() == texts and len(parts) > 1


def ngrams(text, max_n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets
    feats = [ngrams(t, max_n) for _, t in docs]
    s = collections.Counter(bucket(g) for _, f in feats for g in f)
    t = collections.Counter(bucket(g) for x in target for g in ngrams(x, max_n)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (n, f) in zip(docs, feats):
        weight = sum(gain[bucket(g)] for g in f) // max(len(f), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    some = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = collections.Counter((*r, k + 1) for k, r in enumerate(some[:percent * len(some) // 100]))
    rest = collections.Counter((*r, None) for r in rows) - collections.Counter((*d[:5], None) for d in drawn)
    return gain, drawn + rest


@pytest.mark.parametrize("options", [{}, {"max_n": 2, "buckets": 500, "min_words": 3, "percent": 35, "seed": 7}])
def test_resampling_equals_plain_python(spark, messy, monkeypatch, options):
    monkeypatch.setattr(importance, "PART_BYTES", 1 << 16)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").unionByName(messy, allowMissingColumns=True)
    target = spark.read.parquet(f"{SF001}/benchmark.parquet")
    got = collections.Counter(tuple(r) for r in resample(docs, target, **options).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())
    _, want = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], **options)
    assert got == want


def test_resampling_of_no_rows_and_no_target(messy, empty):
    assert resample(empty, messy).count() == 0
    gains, _ = brute_resample([(r["doc_id"], r["text"]) for r in messy.collect()], [])
    assert bucket_gains(messy, empty).tolist() == gains
    rows = resample(messy, empty, min_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, messy.count() + 1))


def brute_fill(pieces, room):
    return max(sum(c) for n in range(len(pieces) + 1) for c in itertools.combinations(pieces, n) if sum(c) <= room)


def test_fullest_combination():
    random.seed(3)
    for _ in range(300):
        pieces, room = [random.randint(1, 30) for _ in range(random.randint(0, 9))], random.randint(0, 60)
        left = collections.Counter(pieces)
        picked = fullest(sorted(left), left, room)
        assert all(left[n] >= k for n, k in picked.items())
        assert sum(n * k for n, k in picked.items()) == brute_fill(pieces, room)


def fewest(pieces, capacity):
    """Number of bins by trying everything."""
    best = len(pieces)

    def go(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + left[0] <= capacity and bins[i] not in bins[:i]:
                go(left[1:], [*bins[:i], bins[i] + left[0], *bins[i + 1:]])
        go(left[1:], [*bins, left[0]])
    go(sorted(pieces, reverse=True), [])
    return best


def unpack(plan, histogram):
    """(sequence, offset, length) of every piece by the plan."""
    out = []
    for n, c in histogram.items():
        row = np.searchsorted(plan.key, (n << bin_packing.RANK_BITS) | np.arange(c), side="right") - 1
        nth = np.arange(c) - plan.first[row]
        out += zip((plan.sequence[row] + nth // plan.times[row]).tolist(), (plan.offset[row] + nth % plan.times[row] * n).tolist(), [n] * c)
    return sorted(out)


def check_layout(places, capacity):
    for _, group in itertools.groupby(places, key=lambda x: x[0]):
        at = 0
        for _, offset, n in group:
            assert offset == at
            at += n
        assert at <= capacity


def test_plan_places_every_piece_once():
    random.seed(5)
    more = 0
    for _ in range(60):
        pieces = [random.randint(1, 20) for _ in range(random.randint(1, 9))]
        h = collections.Counter(pieces)
        plan = minimum_slack(h, 20)
        places = unpack(plan, h)
        assert len({(s, o) for s, o, _ in places}) == len(pieces) and {s for s, _, _ in places} == set(range(plan.n_sequences))
        check_layout(places, 20)
        more += plan.n_sequences - fewest(pieces, 20)
    assert more <= 1  # of 60 cases
    many = {n: 3_000_000_000 + n for n in range(1, 2049)}  # steps don't grow with the counts
    plan = minimum_slack(many, 2048)
    assert len(plan.key) < 20_000 and plan.n_sequences <= 1.0001 * sum(n * c for n, c in many.items()) / 2048
    assert minimum_slack({}, 2048).n_sequences == 0


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packed_documents_hold_their_ids(spark, messy, capacity):
    docs = messy.union(messy.where("doc_id >= 100")).repartition(3)
    whole = tokenizers.Tokenizer.from_file(WORDS_FILE)
    packed = pack(token_pieces(docs, WORDS_FILE, 0, capacity=capacity), capacity=capacity)
    rows = packed.collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.update((r["doc_id"], k // capacity, k, len(ids[k:k + capacity]), np.array(ids[k:k + capacity], "<u4").tobytes()) for k in range(0, len(ids), capacity))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    check_layout(sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows), capacity)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // capacity) + 1
    inside = collections.defaultdict(dict)
    for r in rows:
        inside[r["sequence_id"]][r["offset"]] = bytes(r["ids"])
    for s in sequences(packed).collect():
        assert bytes(s["ids"]) == b"".join(inside[s["sequence_id"]][o] for o in sorted(inside[s["sequence_id"]]))
        assert 4 * sum(s["lengths"]) == len(s["ids"])


def test_packing_of_no_rows(empty):
    assert pack(token_pieces(empty, WORDS_FILE, 0)).count() == 0
