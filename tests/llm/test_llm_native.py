"""Mixing, line dedup and the pipeline."""

import collections
import re

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm.line_dedup import remove_boilerplate
from corpusflow.llm.mixing import mix_sources, mixed_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF001 = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Share by weight, cap, reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        above = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not above:
            target.update({s: w[s] * level for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in above})
        left -= sum(target[s] for s in above)
        free -= above
    return target


def check_mix(rows, docs):
    sizes = collections.Counter()
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in rows:
        s = r["row"]["source"]
        assert r["size"] == len(WORD.findall(r["row"]["text"] or "")) and r["source_size"] == sizes[s]
        assert abs(r["target"] - want[s]) <= 1e-9 * max(1, want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(rows) == len(docs)
    for s in sizes:
        assert taken[s] == round(want[s])


def test_mix_hits_every_target(spark, messy, empty):
    for docs in (messy, spark.read.parquet(f"{SF001}/documents.parquet")):
        check_mix(mix_sources(docs).collect(), docs.collect())
    assert mix_sources(empty).count() == 0


def test_mix_does_not_depend_on_partitions_or_buckets(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    one, two, three = (sorted((r["row"]["doc_id"], r["taken"]) for r in mix_sources(d, bucket_hex=b).collect())
                       for d, b in ((docs, 3), (docs.repartition(7), 3), (docs, 1)))
    assert one == two == three


def test_mixed_documents_hold_the_words_taken(spark, messy, empty):
    for docs in (messy, spark.read.parquet(f"{SF001}/documents.parquet")):
        mix = {(r["row"]["doc_id"], r["row"]["text"]): r["taken"] for r in mix_sources(docs.dropDuplicates(["doc_id", "text"])).collect()}
        out = mixed_documents(docs.dropDuplicates(["doc_id", "text"]))
        assert out.columns == docs.columns
        words = collections.Counter()
        for r in out.collect():
            words[r["doc_id"]] += len(WORD.findall(r["text"]))
            assert any(t and t.startswith(r["text"]) for i, t in mix if i == r["doc_id"])
        want = collections.Counter()
        for (i, _), n in mix.items():
            want[i] += n
        assert +words == +want
    assert mixed_documents(empty).count() == 0


def brute_lines(rows, min_sites):
    sites, first = collections.defaultdict(set), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        for pos, line in enumerate((rows[i][1] or "").split("\n")):
            if WORD.search(line):
                if rows[i][2] is not None:
                    sites[line].add(rows[i][2])
                first.setdefault(line, (rows[i][:2], pos))
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        gone = [len(sites[x]) >= min_sites and first.get(x) != ((i, t), p) for p, x in enumerate(lines)]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return out


def test_line_dedup_matches_brute_force(spark, messy, empty):
    for docs, k in ((messy, 10), (messy, 12), (messy, 13), (spark.read.parquet(f"{SF001}/documents.parquet"), 3)):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        got = [(r["row"]["doc_id"], r["row"]["text"], r["n_lines"], r["n_removed"]) for r in remove_boilerplate(docs, min_sites=k).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute_lines(rows, k)))
    out = remove_boilerplate(messy, min_sites=10)
    assert out.select("row.*").columns == messy.columns
    for r in out.where("n_removed > 0").collect():
        assert r["row"]["n_chars"] == len(r["row"]["text"])
    assert remove_boilerplate(empty).count() == 0


def test_line_dedup_by_coarse_sketches_counts_near_lines_exactly(spark):
    rows = [(100 * n + s, f"shared by {n}", f"site{s}") for n in range(1, 60) for s in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = remove_boilerplate(docs, min_sites=30, n_chars=None, lg_k=4).where("n_removed > 0").select("row.doc_id").collect()
    assert {r["doc_id"] for r in got} == {100 * n + s for n in range(30, 60) for s in range(1, n)}


def test_pipeline_stages_on_messy_documents(spark, messy, tmp_path):
    labels = spark.createDataFrame([(100 + i, 1) for i in range(12)] + [(8, 0), (None, 1), (5, None)], "doc_id long, quality int")
    sf = str(tmp_path / "sf")
    messy.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    empty = messy.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, messy, sf)
        assert out.count() >= 0 and (out.columns == messy.columns or k == len(corpus_pipeline.STAGES) - 1)
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_keeps_good_text_and_tokenises_what_is_left(spark):
    """Each stage against plain Python, on what the stage before it kept."""
    from test_llm_dedup import brute_fingerprint, brute_groups
    docs, kept = spark.read.parquet(f"{SF001}/documents.parquet").cache(), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF001).collect(), stage(spark, docs, SF001).schema)
        kept.append(docs.collect())
    quality, lines, simhash, mixed, tokens = kept
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    good = [i for i, q in label.items() if q == 1]
    assert np.mean([i in {r["doc_id"] for r in quality} for i in good]) >= 0.95
    assert len(lines) == len(quality)
    want = brute_lines([(r["doc_id"], r["text"], r["source"]) for r in quality], 10)
    assert sorted((r["doc_id"], r["text"]) for r in lines) == sorted((i, t) for i, t, _, _ in want)
    groups = brute_groups([r["doc_id"] for r in lines], [brute_fingerprint(r["text"]) for r in lines])
    assert sorted(r["doc_id"] for r in simhash) == sorted(set(groups))
    sizes = collections.Counter()
    for r in simhash:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    taken = collections.Counter()
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert +taken == collections.Counter({s: round(t) for s, t in brute_targets(sizes).items() if round(t)})
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = sorted((r["doc_id"], [1, *sp.encode(r["text"]), 2]) for r in mixed)
    assert ids == sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokens)
