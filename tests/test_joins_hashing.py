"""Joins and per-position draws against brute force on small inputs."""

import math
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from corpusflow.functions.hashing import row_hash32, sql_row_hash32, sql_sub_uniform, sub_uniform
from corpusflow.operators import joins as J


def test_sub_uniform_matches_duckdb_and_is_uniform(spark):
    df = spark.range(300).select(F.col("id").alias("k"), F.posexplode(F.array_repeat(F.lit(0), 40)).alias("i", "z"))
    u = df.select("k", "i", sub_uniform(row_hash32(9, "k"), F.col("i")).alias("u"))
    mine = sorted((r.k, r.i, r.u) for r in u.collect())
    q = f"SELECT k, i, {sql_sub_uniform(sql_row_hash32(9, 'k'), 'i')} FROM range(300) a(k), range(40) b(i)"
    assert mine == sorted(duckdb.connect().execute(q).fetchall())
    vals = [x[2] for x in mine]
    assert abs(sum(vals) / len(vals) - 0.5) < 0.01
    assert abs(sum(v < 0.1 for v in vals) / len(vals) - 0.1) < 0.01


def _cos(a, b):
    ca, cb = Counter(a), Counter(b)
    dot = sum(ca[t] * cb[t] for t in ca)
    na, nb = math.sqrt(sum(v * v for v in ca.values())), math.sqrt(sum(v * v for v in cb.values()))
    return None if na == 0 or nb == 0 else dot / (na * nb)


def test_keyed_bag_cosine_brute_force(spark):
    rows = [(1, ["a", "b", "a", "c"], ["a", "c"]), (2, ["x"], ["x"]), (3, ["p", "q"], []), (4, [], []),
            (5, ["m", "m", "m", "n"], ["n", "m"])]
    df = spark.createDataFrame(rows, "k long, a array<string>, b array<string>")
    got = {r.k: r.cosine for r in J.keyed_bag_cosine(df, "k", F.col("a"), F.col("b")).collect()}
    for k, a, b in rows:
        exp = _cos(a, b)
        assert (got.get(k) is None) == (exp is None), k
        if exp is not None:
            assert abs(got[k] - exp) < 1e-12


def test_contains_first_match_brute_force(spark):
    a = spark.createDataFrame([("layer.0.attention.q_lin",), ("ffn",), ("lin",), ("zzz",)], "name string")
    b = spark.createDataFrame([("q_lin", 2), ("attention", 1), ("ffn.lin1", 3), ("lin", 4)], "key string, pos int")
    got = {r.name: r.match for r in J.contains_first_match(a, "name", b, "key", "pos").collect()}
    keys = [("attention", 1), ("q_lin", 2), ("ffn.lin1", 3), ("lin", 4)]
    for name in ["layer.0.attention.q_lin", "ffn", "lin", "zzz"]:
        hits = [k for k, p in keys if k in name or name in k]
        assert got[name] == (hits[0] if hits else None), name


def test_layer_token_join_last_match_wins(spark):
    m = spark.createDataFrame([("enc.layer.1.attn.q_lin.weight",), ("enc.layer.11.ffn.weight",),
                               ("enc.layer.2.x.layer.1.q_lin",), ("enc.layer.3.norm",)], "name string")
    g = spark.createDataFrame([(1, 0, 10), (2, 1, 20), (11, 2, 110)], "layer int, pos int, units int")
    got = {r.name: (r.layer, r.units) for r in J.layer_token_join(m, "name", g, "layer", "pos", ["q_lin", "ffn"], "units", out="units").collect()}
    assert got == {"enc.layer.1.attn.q_lin.weight": (1, 10), "enc.layer.11.ffn.weight": (11, 110),
                   "enc.layer.2.x.layer.1.q_lin": (2, 20)}


def test_warm_start_name_matching(spark):
    """J3 on parameter names: adapter weights are reduced to their core module
    path and matched to the first warm-start key (in insertion order) whose
    core contains it or is contained in it."""
    mods = [(f"base_model.model.distilbert.transformer.layer.{l}.attention.{m}.lora_{p}.default.weight",)
            for l in (0, 1, 11) for m in ("q_lin", "v_lin") for p in ("A", "B")]
    a = spark.createDataFrame(mods, "name string").withColumn("core", J.remove_substrings(
        F.col("name"), ["base_model.model.", ".lora_A.default.weight", ".lora_B.default.weight",
                        ".lora_A.weight", ".lora_B.weight"]))
    keys = [(f"distilbert.transformer.layer.{l}.attention.{m}.weight", i)
            for i, (l, m) in enumerate((l, m) for l in (0, 1, 11) for m in ("q_lin", "v_lin"))]
    b = (spark.createDataFrame(keys, "ws_key string, pos int")
              .withColumn("ws_core", J.remove_substrings(F.col("ws_key"), [".weight", ".bias"])))
    got = {r.core: r.match for r in J.contains_first_match(a, "core", b, "ws_core", "pos").collect()}
    for name, in mods:
        core = name.replace("base_model.model.", "").replace(".lora_A.default.weight", "").replace(".lora_B.default.weight", "")
        exp = next(k.replace(".weight", "") for k, _ in keys if k.replace(".weight", "") in core or core in k.replace(".weight", ""))
        assert got[core] == exp
