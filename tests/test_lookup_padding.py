"""Lookups inside the row (T7, T10, T15) against the join they replace, and padded batches."""

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import encode as EN
from corpusflow.operators import lookup
from corpusflow.operators import noise as NZ
from corpusflow.operators.lookup import row_lookup

TEXTS = ["the cat, the dog!", "", None, "  ", "(Cat) CAT cat. <dog> éclair", "the the the", "naïve café the"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


def test_lookup_finds_each_key_once(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), (None, 5), ("c", None), ("", 7), ("é\n\"x", 8)] + [(f"w{i}", i) for i in range(300)], "k string, v int")
    find = row_lookup(table, "k", "v")
    keys = ["a", "b", "c", "", "é\n\"x", "zz", None, "w0", "w299", "w300"]
    got = spark.createDataFrame([(k,) for k in keys], "x string").select("x", find(F.col("x")).alias("v")).collect()
    assert {r["x"]: r["v"] for r in got} == {"a": 1, "b": 1, "c": None, "": 7, "é\n\"x": 8, "zz": None, None: None, "w0": 0, "w299": 299, "w300": None}
    none = row_lookup(table.limit(0), "k", "v")
    assert spark.createDataFrame([("a",)], "x string").select(none(F.col("x")).alias("v")).first()["v"] is None
    assert row_lookup(table, "k", "v", max_bytes=100) is None


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_rows_and_join_give_the_same(spark, monkeypatch, size):
    d = docs(spark)
    vocab = EN.build_vocab(d, "text", size)
    cache = vocab.select("term", F.concat("term", F.lit("~")).alias("replacement"))

    def run():
        return [collected(EN.encode(d, "id", "text", vocab, 4)), collected(EN.oov_ratio(d, "id", "text", vocab)),
                collected(EN.encode_ragged(d, "id", "text", vocab, None)), collected(NZ.replace_from_cache(d, "text", "id", cache, 0.6, 3).select("id", "text_out"))]

    inside = run()
    monkeypatch.setattr(lookup, "LOOKUP_BYTES", 0)
    assert run() == inside


def test_a_lookup_moves_no_rows(spark):
    d = docs(spark)
    vocab = EN.build_vocab(d, "text", 50)
    for df in (EN.encode(d, "id", "text", vocab, 4), EN.oov_ratio(d, "id", "text", vocab)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Generate" not in plan and "Join" not in plan
        assert plan.count("Exchange") == 1  # the test's own repartition


def test_rows_are_padded_to_their_batch(spark):
    rows = [(1, 0, [5, 6, 7], 3), (2, 0, [8], 1), (3, 1, [], 0), (4, 1, [], 0), (5, None, [9, 9], 2), (6, 2, [4], 1)]
    e = spark.createDataFrame(rows, "id long, batch_id int, ids array<int>, n_tokens int").repartition(4)
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = {r["id"]: (r["padded_len"], r["input_ids"], r["attention_mask"]) for r in EN.pad_batches(e, "batch_id").collect()}
        assert got == {1: (3, [5, 6, 7], [1, 1, 1]), 2: (3, [8, 0, 0], [1, 0, 0]), 3: (0, [], []), 4: (0, [], []), 5: (2, [9, 9], [1, 1]), 6: (1, [4], [1])}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert EN.pad_batches(e.limit(0), "batch_id").count() == 0
