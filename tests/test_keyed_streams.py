"""Result files by experiment (R1), progress by steps (R2), summaries by commits."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.session import scratch_dir
from corpusflow.sources import versions as V
from corpusflow.streaming import keyed as K
from corpusflow.streaming import stream as ST


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def result(name, stamp, accuracy):
    return {"experiment_name": name, "timestamp": stamp, "eval_results": {"eval_accuracy": accuracy}}


def test_a_redelivered_result_counts_once(spark, tmp_path):
    src, sink, ckpt = tmp_path / "in", f"file://{tmp_path}/sink", f"file://{tmp_path}/ckpt"
    run = lambda: K.ingest_results(spark, f"file://{src}", sink, ckpt)
    put(src, "a.json", json.dumps(result("a", "t1", 0.5), indent=2))
    put(src, "a_again.json", json.dumps(result("a", "t1", 0.5)))  # the same micro-batch
    put(src, "b.json", json.dumps(result("b", "t1", 0.6))[:30])  # cut off
    run()
    put(src, "a_late.json", json.dumps(result("a", "t1", 0.9)))  # a later one: the first delivery stays
    put(src, "b_whole.json", json.dumps(result("b", "t1", 0.6)))
    put(src, "b_cut_again.json", json.dumps(result("b", "t1", 0.6))[:30])
    put(src, "a_rerun.json", json.dumps(result("a", "t2", 0.7)) + "\n" + json.dumps(result("c", None, 0.8)) + "\n{broken")
    run()
    run()  # nothing new
    good = {(r["experiment_name"], r["timestamp"]): r["eval_results"]["eval_accuracy"] for r in K.ingested(spark, sink).collect()}
    assert good == {("a", "t1"): 0.5, ("a", "t2"): 0.7, ("b", "t1"): 0.6, ("c", None): 0.8}
    assert K.ingested(spark, sink).count() == 4
    bad = collections.Counter(r["_doc"] for r in K.ingested(spark, sink, "corrupt").collect())
    assert bad == {json.dumps(result("b", "t1", 0.6))[:30]: 1, "{broken": 1}
    assert K.ingested(spark, sink, "corrupt").where(F.col("_file").contains("/b.json")).count() == 1


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, who string, at timestamp")


def test_progress_in_any_order(spark):
    random.seed(5)
    rows = [(i, random.choice("aab") if i % 50 else None, 1_700_000_000 + i) for i in range(2_000)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, who string, s long").withColumn("at", F.timestamp_seconds("s"))
    src, sink, ckpt = (scratch_dir(spark, f"t-steps-{x}") for x in ("in", "sink", "ckpt"))
    for part in (df.where("id % 3 = 0"), df.where("id % 3 = 1"), df.where("id % 3 = 2")):
        part.repartition(3).write.mode("append").parquet(src)
        steps = K.progress_every(ST.file_stream(spark, src, df.schema, max_files=2), "who", 100)
        ST.run_available_now(steps, sink, ckpt, "append")
    got = collections.Counter((r["who"], r["step"], r["closing"]) for r in spark.read.parquet(sink).collect())
    n = collections.Counter(w for _, w, _ in rows)
    assert got == {(w, s, False): 1 for w in n for s in range(100, n[w] + 1, 100)}


def test_an_idle_key_is_closed_by_its_timer(spark):
    src, sink, ckpt = (scratch_dir(spark, f"t-idle-{x}") for x in ("in", "sink", "ckpt"))
    day, begin = 86_400, 1_700_000_000  # what is not after 1970 began is late for a watermark from the start
    parts = [[("a", 0)] * 5 + [("b", 10)] * 3, [("b", 5 * day)] * 4, [("b", 9 * day), ("a", 9 * day)]]
    for part in parts:
        df = spark.createDataFrame(part, "who string, s long").select("who", F.timestamp_seconds(F.col("s") + begin).alias("at"))
        df.coalesce(1).write.mode("append").parquet(src)
        steps = K.progress_every(ST.file_stream(spark, src, df.schema), "who", 2, ts="at", delay="1 hour", idle_ms=2 * day * 1000)
        ST.run_available_now(steps, sink, ckpt, "append")
    got = collections.Counter((r["who"], r["step"], r["closing"]) for r in spark.read.parquet(sink).collect())
    assert got[("a", 5, True)] == 1  # closed with the step it had reached, between its hundredths
    assert got[("a", 2, False)] == got[("a", 4, False)] == 1
    assert got[("b", 2, False)] >= 1 and sum(n for (w, _, c), n in got.items() if w == "a" and c) == 1


def test_versions_grow_and_can_be_read(spark, tmp_path):
    path = f"file://{tmp_path}/summary"
    assert V.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        V.read(spark, path)
    assert V.append(spark.createDataFrame([(1, "a")], "x int, y string"), path) == 1
    assert V.append(spark.createDataFrame([(2, 0.5)], "x int, z double"), path) == 2
    rows = lambda v=None: sorted(tuple(r) for r in V.read(spark, path, v).select(*[c for c in ("x", "y", "z") if v != 1 or c != "z"]).collect())
    assert rows(1) == [(1, "a")] and rows() == rows(2) == [(1, "a", None), (2, None, 0.5)]
    assert V.rewrite(spark, path) == 3 and rows(3) == rows(2)
    assert [tuple(r) for r in V.history(spark, path).orderBy("version").collect()] == [(1, 1), (2, 2), (3, 2)]


def test_a_failed_append_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/summary"
    V.append(spark.range(3), path)

    def fail(*args):
        raise OSError("the writer is gone")

    with monkeypatch.context() as m:
        m.setattr(V, "_commit", fail)  # rows are written, the commit is not
        with pytest.raises(OSError):
            V.append(spark.range(100), path)
    assert len(list((tmp_path / "summary" / "data").iterdir())) == 2
    assert V.versions(spark, path) == [1] and V.read(spark, path).count() == 3
    assert V.append(spark.range(3, 5), path) == 2 and V.read(spark, path).count() == 5


def test_of_two_appends_at_once_both_stay(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/summary"
    V.append(spark.range(1), path)
    first, real = [], V._commit

    def late(s, p, version, folders):
        if not first:  # another writer commits version 2 in between
            first.append(version)
            monkeypatch.setattr(V, "_commit", real)
            V.append(spark.range(10, 13), path)
            monkeypatch.setattr(V, "_commit", late)
        return real(s, p, version, folders)

    monkeypatch.setattr(V, "_commit", late)
    assert V.append(spark.range(20, 22), path) == 3 and first == [2]
    assert sorted(r["id"] for r in V.read(spark, path).collect()) == [0, 10, 11, 12, 20, 21]
