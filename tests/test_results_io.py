"""Result documents, CSV splits and config maps."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import schema as P
from corpusflow.session import scratch_dir
from corpusflow.sources import csv_splits as CSV
from corpusflow.sources import results as R

BUDGETED = {
    "experiment_name": "spread", "timestamp": "2024-02-03T04:05:06.000007", "duration_seconds": 90.0,
    "config": {"model": "tiny", "dataset": "reviews", "peft_method": "ba_lora", "epochs": 3, "seed": 7,
               "ba_lora_config": {"base_rank": 2, "gradient_samples": 10, "use_warmstart": True, "alpha": 4}},
    "model_info": {"trainable_parameters": 1234, "peft_parameters": 900, "budget_usage_percentage": 90.0},
    "eval_results": {"eval_accuracy": 0.75, "eval_f1": 0.5, "eval_precision": 0.625, "eval_recall": 0.25, "epoch": 3.0},
    "parameter_budget": {"target": 1000, "used": 900, "usage_percentage": 90.0, "within_budget": True},
}
FIXED = {"experiment_name": "plain", "duration_seconds": 45.0,
         "config": {"peft_method": "lora", "dataset": "reviews", "epochs": 3, "lora_config": {"r": 4, "lora_alpha": 8}},
         "model_info": {"trainable_parameters": 567},
         "eval_results": {"eval_accuracy": 0.5, "eval_f1": 0.375}}
NO_CONFIG = {"experiment_name": "legacy", "peft_method": "adapter", "epochs": 2, "peft_config": {"reduction_factor": 16}}


def test_scan_summary_and_corrupt(spark, tmp_path):
    d = tmp_path / "res"
    d.mkdir()
    for i, doc in enumerate([BUDGETED, FIXED, NO_CONFIG]):
        (d / f"r{i}.json").write_text(json.dumps(doc, indent=2))
    (d / "bad.json").write_text("{ not json")
    good, bad = R.read_results(spark, str(d))
    assert bad.select("_corrupt", "experiment_name").count() == 1
    s = {r.experiment: r for r in R.summary_table(good).collect()}
    b = s["spread"]
    assert b.method == "ba_lora" and b.epochs == 3 and b.accuracy == 75.0
    assert b.duration_min == 1.5 and b.lora_r is None
    assert s["plain"].lora_r == 4 and s["plain"].precision == 0.0
    assert s["legacy"].method == "adapter" and s["legacy"].epochs == 2 and s["legacy"].adapter_rf == 16
    row = R.summary_row(good).where("experiment = 'spread'").collect()[0]
    assert row.trainable_params == 1234


def test_a_broken_line_loses_only_itself(spark, tmp_path):
    d = tmp_path / "lines"
    d.mkdir()
    good_lines = [json.dumps({"experiment_name": f"r{i}", "epochs": i}) for i in range(3)]
    for name, lines in (("first", ["{ broken", *good_lines]), ("third", [*good_lines[:2], "{ broken", good_lines[2]]),
                        ("dos", [x + "\r" for x in good_lines])):
        (d / f"{name}.json").write_text("\n".join(lines) + "\n")
    (d / "pretty.json").write_text(json.dumps(BUDGETED, indent=1))
    good, bad = R.read_results(spark, str(d))
    assert sorted(r.experiment_name for r in good.collect()) == sorted(["r0", "r1", "r2"] * 3 + ["spread"])
    assert bad.select("_corrupt", "_file", "experiment_name").count() == 2
    (d / "pretty.json").unlink()
    good, bad = R.read_results(spark, str(d), lines=True)
    assert good.count() == 9 and bad.select("_corrupt", "_file", "experiment_name").count() == 2


def test_missing_results_dir_is_empty(spark, tmp_path):
    good, bad = R.read_results(spark, str(tmp_path / "nope"))
    assert good.count() == 0 and bad.count() == 0


def test_csv_split_roundtrip_and_missing(spark):
    base = scratch_dir(spark, "t-csv")
    df = spark.createDataFrame([(1, 'a "quoted"\nline', 0, "train"), (2, "  padded  ", 1, "test")],
                               "doc_id bigint, text string, label int, split string")
    CSV.write_split_csv(df, base, "x")
    back = CSV.load_split_csv(spark, base, "x", "doc_id bigint, text string, label int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileNotFoundError):
        CSV.load_split_csv(spark, base, "nothing", "doc_id bigint")
    with pytest.raises(FileNotFoundError):
        CSV.load_csv_map(spark, {"train": os.path.join(base, "missing.csv")}, "doc_id bigint")


def test_merge_and_flatten_config(spark):
    df = spark.createDataFrame([(1,)], "x int")
    g = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3"))
    b = F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("d"), F.lit("true"))
    e = F.create_map(F.lit("c"), F.lit("9"), F.lit("e"), F.lit("false"), F.lit("name"), F.lit("run1"))
    r = df.select(F.map_keys(P.merge_config(g, b, e)).alias("k"), F.map_values(P.merge_config(g, b, e)).alias("v")).collect()[0]
    # dict-merge semantics: b's null override removes "b"; "c" keeps its first position
    # (order read through map_keys: collecting a map into Python loses it)
    assert list(zip(r.k, r.v)) == [("a", "1"), ("c", "9"), ("d", "true"), ("e", "false"), ("name", "run1")]
    toks = df.select(P.flatten_config(P.merge_config(g, b, e)).alias("t")).collect()[0].t
    assert toks == ["--a", "1", "--c", "9", "--d"]


def test_flatten_nested_lists_and_flags(spark):
    cfg = F.create_map(
        F.lit("model"), F.lit("distilbert"), F.lit("epochs"), F.lit("3"),
        F.lit("lora_config"), F.lit('{"r": 8, "use_rslora": true, "fan_in": false, "modules": ["q", "v"], "skip": null}'),
        F.lit("seeds"), F.lit("[1, 2]"), F.lit("tags"), F.lit("[]"), F.lit("fp16"), F.lit("true"),
        F.lit("description"), F.lit("x"), F.lit("warm"), F.lit(None).cast("string"))
    t = spark.range(1).select(P.flatten_config(cfg).alias("t")).collect()[0].t
    assert t == ["--model", "distilbert", "--epochs", "3", "--r", "8", "--use_rslora", "--modules", "q", "v",
                 "--seeds", "1", "2", "--fp16"]


def test_registry_lookup(spark):
    assert P.dataset_info(spark, "sst2").collect()[0].text_column == "sentence"
    with pytest.raises(ValueError):
        P.dataset_info(spark, "nope")


def test_manifest_document(spark):
    base = scratch_dir(spark, "t-man")
    df = spark.createDataFrame([(1, "a", 0, "train"), (2, "b", 1, "train"), (3, "c", 0, "test")],
                               "doc_id bigint, text string, label int, split string")
    out = CSV.write_split_csv(df, base, "x")
    back = CSV.load_split_csv(spark, base, "x", "doc_id bigint, text string, label int")
    doc = CSV.manifest_document(CSV.manifest(back, "x"), out).collect()[0]
    assert doc.splits == ["test", "train"] and doc.rows_per_split == {"train": 2, "test": 1}
    assert doc.num_samples == -1 and len(doc.files) >= 2 and doc.outdir == out
    CSV.write_manifest(CSV.manifest_document(CSV.manifest(back, "x"), out), base + "/manifest")
    assert spark.read.json(base + "/manifest").count() == 1


def test_summary_rows_and_append(spark, tmp_path):
    d = tmp_path / "two"
    d.mkdir()
    (d / "a.json").write_text(json.dumps(FIXED, indent=2))
    (d / "b.json").write_text(json.dumps(BUDGETED, indent=2))
    want = [("plain", "lora", "reviews", 0.5, 0.375, 567, 0.75), ("spread", "ba_lora", "reviews", 0.75, 0.5, 1234, 1.5)]
    good, bad = R.read_results(spark, str(d))
    assert bad.select("_corrupt", "experiment_name").count() == 0
    assert sorted(tuple(r) for r in R.summary_row(good).collect()) == want
    # Appending the new row to the old summary keeps both, schema-tolerant
    old = spark.createDataFrame(want[:1], "experiment string, method string, dataset string, accuracy double, "
                                          "f1 double, trainable_params bigint, duration_min double")
    both = P.union_tolerant(old, R.summary_row(good).where("experiment = 'spread'"))
    assert sorted(tuple(r) for r in both.collect()) == want


def test_compiled_result_layout(spark):
    """A compiled result carries the method-specific block of its method only,
    and the budget block only when there is a target (nulls are omitted in JSON)."""
    rows = [("lora_r4", "lora", None), ("budget_37k", "ba_lora", 37500)]
    df = spark.createDataFrame(rows, "experiment_name string, peft_method string, target bigint")
    c = {"experiment_name": F.col("experiment_name"), "peft_method": F.col("peft_method"),
         "timestamp": F.lit("2025-01-01T00:00:00.000000"), "duration_seconds": F.lit(60.0),
         "model": F.lit("m"), "dataset": F.lit("sst2"), "epochs": F.lit(3), "batch_size": F.lit(32),
         "learning_rate": F.lit(5e-4), "seed": F.lit(42), "max_length": F.lit(128), "lora_r": F.lit(4),
         "base_rank": F.lit(4), "gradient_samples": F.lit(2000), "eval_loss": F.lit(0.3),
         "eval_accuracy": F.lit(0.9), "eval_f1": F.lit(0.9), "eval_precision": F.lit(0.9), "eval_recall": F.lit(0.9),
         "eval_runtime": F.lit(6.0), "eval_samples_per_second": F.lit(135.0), "eval_steps_per_second": F.lit(4.3),
         "epoch": F.lit(3.0), "trainable_parameters": F.lit(628994).cast("bigint"), "target": F.col("target"),
         "used": F.lit(36864).cast("bigint")}
    docs = {r.experiment_name: json.loads(r.j) for r in
            df.select("experiment_name", F.to_json(R.compile_result(c)).alias("j")).collect()}
    lo, ba = docs["lora_r4"], docs["budget_37k"]
    assert lo["config"]["lora_config"] == {"r": 4, "lora_alpha": 8, "lora_dropout": 0.1}
    assert "ba_lora_config" not in lo["config"] and "parameter_budget" not in lo
    assert ba["config"]["ba_lora_config"] == {"base_rank": 4, "gradient_samples": 2000, "use_warmstart": True, "alpha": 8}
    assert "lora_config" not in ba["config"]
    assert ba["parameter_budget"] == {"target": 37500, "used": 36864, "usage_percentage": 98.304, "within_budget": True}


def test_write_rows_gives_one_text_line_each(spark):
    path = scratch_dir(spark, "t-rows")
    CSV.write_rows(spark.createDataFrame([("a & 1 \\\\",), ("b & 2 \\\\",)], "row string"), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["a & 1 \\\\", "b & 2 \\\\"]
