"""Near-dedup operators against brute force."""

import numpy as np
import pyarrow.dataset as ds
import pytest
import xxhash

from corpusflow.llm import nn_descent
from corpusflow.llm.components import connected_components
from corpusflow.llm.nn_descent import near_duplicates
from corpusflow.llm.simhash import error_patterns, fingerprint_groups, remainders, simhash_dedup, simhash_groups

SF01 = "/root/testdata/sf0.01"


def unions(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (300, 301), (None, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_code_is_perfect_and_covers():
    t = error_patterns(3)
    assert len(t) == 145_499
    home = np.bincount(t["_syn"].to_numpy()[t["_flips"].to_numpy() == 0], minlength=2048)
    assert (home == 1).all() and len(set(remainders())) == 23


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_groups(ids, fps):
    fps = np.array(fps, dtype=np.uint64)
    linked = [(i, int(j) + i + 1) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= 3)]
    roots = unions(len(fps), linked)
    low = {}
    for i, r in enumerate(roots):
        if ids[i] is not None:
            low[r] = min(low.get(r, ids[i]), ids[i])
    return [low.get(r) for r in roots]


def test_simhash_groups_match_brute_force(spark):
    docs = ds.dataset(f"{SF01}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    want = dict(zip(docs["doc_id"], brute_groups(docs["doc_id"], [brute_fingerprint(t) for t in docs["text"]])))
    got = simhash_groups(spark.read.parquet(f"{SF01}/documents.parquet")).collect()
    assert {r["id"]: r["component_id"] for r in got} == want
    assert {r["id"]: r["fp"] % (1 << 64) for r in got} == dict(zip(docs["doc_id"], map(brute_fingerprint, docs["text"])))


@pytest.mark.parametrize("codes,block", [(1, 4096), (2, 4096), (1, 8)])
def test_all_links_of_planted_fingerprints_are_found(spark, codes, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 150, dtype=np.uint64)
    fps = list(base)
    for k in range(250):  # up to three bits away, in crowds around a few of them
        x = int(base[k % 20])
        for b in rng.choice(64, size=k % 5, replace=False):
            x ^= 1 << int(b)
        fps.append(np.uint64(x))
    fps = [int(x) for x in fps]
    ids = [int(i) for i in rng.permutation(len(fps))]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = fingerprint_groups(spark.createDataFrame(list(zip(ids, signed)), "id long, fp long"), codes=codes, block=block)
    assert {r["id"]: r["component_id"] for r in got.collect()} == dict(zip(ids, brute_groups(ids, fps)))


def test_simhash_of_messy_rows(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = simhash_groups(messy).collect()
    assert len(got) == len(rows)
    want = brute_groups([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    assert sorted(map(str, want)) == sorted(str(r["component_id"]) for r in got)
    kept = simhash_dedup(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len({r["component_id"] for r in got})
    assert simhash_groups(empty).count() == 0 and simhash_dedup(empty).count() == 0


def test_simhash_dedup_keeps_unrelated_texts_of_null_and_repeated_ids(spark):
    rows = [(None, "one text of its own without any id"), (None, "quite another story, told by nobody at all"),
            (None, "a third page that names no number either"), (7, "seven is the id of these words here"),
            (7, "and seven again for something wholly different"), (8, "twice the same"), (9, "twice the same")]
    kept = simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, rows[:6]))


def brute_links(rows, threshold=0.95):
    ok, unit = [], []
    for _, v in rows:
        x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) if v else np.zeros(0)
        good = len(x) > 0 and np.isfinite(x).all() and (x != 0).any()
        ok.append(good)
        unit.append(x / np.linalg.norm(x) if good else x)
    linked = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
              if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    n = np.bincount([x for p in linked for x in p], minlength=len(rows))
    roots, low = unions(len(rows), linked), {}
    for i, r in enumerate(roots):
        if rows[i][0] is not None:
            low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    return [(rows[i][0], int(n[i]), low.get(r)) for i, r in enumerate(roots)]


def vectors():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    rows = [rng.normal(size=16) for _ in range(150)]
    rows += [centre + 0.05 * rng.normal(size=16) for _ in range(60)]  # more than a list holds
    rows += [rows[k] * 3 for k in range(10)] + [rows[0]] * 4
    out = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows)]
    out += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [float("inf")] + [1.0] * 15), (904, []),
            (905, [None] + [1.0] * 15), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (None, [2.0, 4.0]), (908, [1e30] * 2), out[3], out[3]]
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_nn_descent_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = near_duplicates(df.selectExpr("*", "1 AS nid", "2 AS copies", "3 AS label")).collect()
    rows32 = [(i, None if v is None else [None if c is None else np.float32(c) for c in v]) for i, v in rows]
    want = brute_links(rows32)
    assert sorted(map(str, want)) == sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def crowds():
    """Three dense crowds in a row, neighbours linked at 0.957, and some pairs."""
    rng, eye = np.random.default_rng(5), np.eye(24)
    turn = np.arccos(0.957)
    centres = [np.cos(k * turn) * eye[0] + np.sin(k * turn) * eye[1] for k in range(3)]
    rows = [c + 0.001 * rng.normal(size=24) for c in centres for _ in range(25)]
    for k in range(20):
        x = rng.normal(size=24)
        rows += [x, x + 0.01 * rng.normal(size=24)]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("rounds", [4, 0])
def test_crowds_joined_by_weaker_links_are_one_component(spark, rounds):
    rows = crowds()
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rounds=rounds).collect()
    want = brute_links([(i, [np.float32(c) for c in v]) for i, v in rows])
    assert sorted(want) == sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert sum(r["kept"] for r in got) == 21 and all(r["audit_recall"] == 1 for r in got)


def test_audit_sees_missed_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(6)
    rows = [np.eye(24)[0] + 0.001 * rng.normal(size=24) for _ in range(100)]
    for _ in range(10):
        x = rng.normal(size=24)
        rows += [x, x + 0.01 * rng.normal(size=24)]
    nodes = spark.createDataFrame([(i, [float(c) for c in v], 50, i) for i, v in enumerate(rows)], "nid long, vec array<double>, copies long, first long")
    large = nn_descent.link_counts(nodes.where("nid < 100").selectExpr("nid", "0L AS root", "copies", "vec"), 0.95)
    assert nn_descent.audit(nodes, large, 0.95) < 0.5


def test_saturated_lists_grow(spark):
    rng, eye = np.random.default_rng(3), np.eye(24)
    sizes = [5, 17, 25, 33, 60]
    rows = [(k, eye[k] + 0.001 * rng.normal(size=24)) for k, size in enumerate(sizes) for _ in range(size)]
    nodes = spark.createDataFrame([(i, i, [float(c) for c in v]) for i, (_, v) in enumerate(rows)], "nid long, root long, vec array<double>")
    found = nn_descent.leaf_pairs(nodes, len(rows), 0.95, 1)
    graph = nn_descent.best_lists(nn_descent.listable(found), 0.95).checkpoint()
    changed = True
    while changed:
        entries, _ = nn_descent.changes(graph)
        graph, _ = nn_descent.refine(nodes, graph, entries, 0.95)
        changed = nn_descent.changes(graph)[1]
    links = {}
    for r in graph.where("sim >= 0.95").collect():
        assert rows[r["u"]][0] == rows[r["v"]][0]
        links.setdefault(r["u"], set()).add(r["v"])
    for i, (k, _) in enumerate(rows):
        assert len(links[i]) == min(sizes[k] - 1, nn_descent.ENLARGED)


def test_estimated_size_of_lists_stays_in_bounds(spark):
    """Joins multiply Spark's estimates and a checkpoint keeps them: in a loop their digits double with every round."""
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(i, i, [float(c) for c in rng.normal(size=8)]) for i in range(100)], "nid long, root long, vec array<double>")
    graph = nn_descent.best_lists(nn_descent.listable(nn_descent.leaf_pairs(nodes, 100, 0.95, 1)), 0.95).checkpoint()
    for _ in range(3):
        graph, _ = nn_descent.refine(nodes, graph, 1600, 0.95)
    assert graph._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63


def test_component_calls_follow_replicated_rows(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(nn_descent, "BLOCK", 10)
    monkeypatch.setattr(nn_descent, "calls", lambda rows: asked.append(rows) or 4)
    members = spark.createDataFrame([(i, 0 if i < 100 else i, 1, [1.0, 0.0]) for i in range(110)], "nid long, root long, copies long, vec array<double>")
    got = {r["nid"]: r["other"] for r in nn_descent.link_counts(members, 0.95).collect()}
    assert asked == [100 * 19 + 10] and got == {i: 99 if i < 100 else 0 for i in range(110)}


def test_zeros_of_either_sign_are_one_vector(spark):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [1.0, 0.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_nn_descent_of_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicates(none).count() == 0
    one = near_duplicates(spark.createDataFrame([(3, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in one] == [(3, 0, 3, True)]
