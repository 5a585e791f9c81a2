"""The prefix trie against a plain one of nested prefixes."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from corpusflow.llm.prefix_trie import extents, least_between, prefix_trie, rebuilt, sparse_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF001 = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:]
    return out


def brute_trie(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in members if len(q) == len(p) + 1 and q[:-1] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def conversations(n, seed):
    """Some of the same turns, some lost, repeated and tied numbers, a crowd of equal conversations and one that is long."""
    random.seed(seed)
    rows = []
    for c in random.sample(range(3 * n), n):
        for t in range(random.randint(1, 5)):
            rows.append((c, random.choice([t, t, t, None, 1]), random.choice(["user", "bot", None, ""]), random.choice(["a b", "a", "", None, "é\nb c"])))
    rows += [(1000 + c, t, "user", "same words here") for c in range(n) for t in range(2)]
    rows += [(5000, t, "user", "same words here") for t in range(60)]
    rows += [(None, 1, "user", "nobody's"), (21, 0, "user", "one turn"), (-7, 0, "user", "before all")] + rows[:3]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("seed, n, options, ranges", [(1, 40, {}, 4), (2, 40, {"block_rows": 3, "block_turns": 7}, 4), (3, 60, {"block_rows": 1}, 2),
                                                       (4, 60, {"block_rows": 5, "block_turns": 9}, 9), (5, 3, {"block_rows": 2}, 1)])
def test_trie_equals_plain_prefixes(spark, seed, n, options, ranges):
    rows = conversations(n, seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS words", "2 AS _t", "3 AS _base").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        trie = got(prefix_trie(rebuilt(df), **options))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute_rebuilt([(c, t, r, x) for c, t, r, x in rows])
    assert trie == brute_trie({c: v for c, v in want.items()})


def test_rebuilt_rows_hold_their_turns(spark):
    rows = conversations(50, 9)
    have = {r["conv_id"]: (len(r["key"]) // 16, list(r["words"])) for r in rebuilt(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert have == {c: (len(t), [len(WORD.findall(x)) for _, x in t]) for c, t in brute_rebuilt(rows).items()}
    assert have[21][0] == max(0, 1 - zlib.crc32(b"21") % 4)  # its base is only there by chance


def test_trie_of_the_test_table(spark):
    df = spark.read.parquet(f"{SF001}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(prefix_trie(rebuilt(df), block_rows=7)) == brute_trie(brute_rebuilt(rows))


def test_trie_of_no_rows_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(rebuilt(none)).count() == 0 and rebuilt(none).count() == 0
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)  # base 20 is not there
    rows = [(c, 0, "user", "gone")]
    assert got(prefix_trie(rebuilt(spark.createDataFrame(rows, SCHEMA)))) == brute_trie(brute_rebuilt(rows)) == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_extents_by_the_table():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 100):
        lcp = rng.integers(-1, 4, n + 1)
        table = sparse_table(lcp)
        row, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        left, right = extents(table, row, depth)
        for r, d, a, b in zip(row, depth, left, right):
            x = r
            while x >= 0 and lcp[x] >= d:
                x -= 1
            y = r
            while y < n and lcp[y + 1] >= d:
                y += 1
            assert (a, b) == (x, y)
        values = rng.integers(0, 99, n)
        first = rng.integers(0, n, 50)
        last = np.array([rng.integers(f, n) for f in first])
        assert least_between(sparse_table(values), first, last).tolist() == [values[f:l + 1].min() for f, l in zip(first, last)]
