"""Experiment result documents: compile, write, scan, summary rows.

A result is one nested JSON object per run.  Method-specific blocks
(``lora_config``, ``ba_lora_config``, ``parameter_budget``) are nullable
structs.  Reading uses an explicit schema in PERMISSIVE mode, so a corrupt
file becomes a row with ``_corrupt`` set instead of failing the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "experiment_name string, timestamp string, duration_seconds double, "
    "config struct<model: string, dataset: string, peft_method: string, epochs: int, batch_size: int, "
    "learning_rate: double, seed: int, max_length: int, "
    "lora_config: struct<r: int, lora_alpha: int, lora_dropout: double>, "
    "ba_lora_config: struct<base_rank: int, gradient_samples: int, use_warmstart: boolean, alpha: int>>, "
    "model_info struct<total_parameters: bigint, trainable_parameters: bigint, frozen_parameters: bigint, "
    "peft_parameters: bigint, added_parameters: bigint, task_head_parameters: bigint, trainable_percentage: double, "
    "parameter_efficiency: double, budget_usage_percentage: double, budget_remaining: bigint, within_budget: boolean>, "
    "eval_results struct<eval_loss: double, eval_accuracy: double, eval_f1: double, eval_precision: double, "
    "eval_recall: double, eval_runtime: double, eval_samples_per_second: double, eval_steps_per_second: double, "
    "epoch: double>, "
    "parameter_budget struct<target: bigint, used: bigint, usage_percentage: double, within_budget: boolean>, "
    # legacy top-level fields some readers expect
    "peft_method string, model string, dataset string, epochs int, "
    "peft_config struct<r: int, reduction_factor: int>, "
    "_corrupt string"
)


def compile_result(r: dict[str, Column]) -> Column:
    """One result struct from flat columns; method-specific blocks only
    for their method (null otherwise)."""
    m = r["peft_method"]
    cfg = F.struct(
        r["model"].alias("model"), r["dataset"].alias("dataset"), m.alias("peft_method"),
        r["epochs"].alias("epochs"), r["batch_size"].alias("batch_size"),
        r["learning_rate"].alias("learning_rate"), r["seed"].alias("seed"), r["max_length"].alias("max_length"),
        F.when(m == "lora", F.struct(r["lora_r"].alias("r"), (r["lora_r"] * 2).alias("lora_alpha"),
                                     F.lit(0.1).alias("lora_dropout"))).alias("lora_config"),
        F.when(m == "ba_lora", F.struct(r["base_rank"].alias("base_rank"), r["gradient_samples"].alias("gradient_samples"),
                                        F.lit(True).alias("use_warmstart"), (r["base_rank"] * 2).alias("alpha"))).alias("ba_lora_config"))
    ev = F.struct(*[r[k].alias(k) for k in ("eval_loss", "eval_accuracy", "eval_f1", "eval_precision", "eval_recall",
                                            "eval_runtime", "eval_samples_per_second", "eval_steps_per_second", "epoch")])
    mi = F.struct(r["trainable_parameters"].alias("trainable_parameters"))
    used = r["used"]
    pb = F.when(r["target"].isNotNull(), F.struct(
        r["target"].alias("target"), used.alias("used"), (used / r["target"] * 100).alias("usage_percentage"),
        (used <= r["target"]).alias("within_budget")))
    return F.struct(r["experiment_name"].alias("experiment_name"), r["timestamp"].alias("timestamp"),
                    r["duration_seconds"].alias("duration_seconds"), cfg.alias("config"), mi.alias("model_info"),
                    ev.alias("eval_results"), pb.alias("parameter_budget"))


def write_results(results: DataFrame, path: str, col: str = "result") -> None:
    """Append one JSON object per run (nulls omitted, like a dict dump)."""
    results.select(f"{col}.*").write.mode("append").option("ignoreNullFields", "true").json(path)


def read_results(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scan a folder of result JSON; returns (good rows, corrupt rows).

    Files may hold one pretty-printed document or JSON Lines (this package's
    sink): each file is read whole and split into lines when any of its lines
    is a complete object that starts at the margin (a pretty-printed document
    has only its braces there), so a broken line loses itself alone.  Every
    document is parsed with ``from_json`` in PERMISSIVE mode; a bad one becomes
    a row with ``_corrupt`` set instead of failing the scan.  With ``lines``
    (every file is JSON Lines, as the sink writes them) files are read by line,
    so a large one is split over tasks.  A missing folder gives two
    empty tables (the reference prints and returns).
    """
    from corpusflow.sources.csv_splits import _fs_exists
    empty = spark.createDataFrame([], RESULT_SCHEMA)
    if not _fs_exists(spark, path):
        return empty, empty.select(F.lit(None).cast("string").alias("_file"), "_corrupt", "experiment_name")
    # the keyword form: ``text()`` would override an earlier ``option("wholetext")``
    t = spark.read.text(path, wholetext=not lines).withColumn("_file", F.input_file_name())
    parsed = parse_documents(t, lines)
    good = parsed.where(~F.col("_bad")).drop("_corrupt", "_doc", "_bad")
    bad = parsed.where("_bad").select("_file", F.coalesce("_corrupt", "_doc").alias("_corrupt"), "experiment_name")
    return good, bad


def parse_documents(texts: DataFrame, lines: bool = False) -> DataFrame:
    """One row per result document in ``value`` (see ``read_results``): ``_file``, the result's fields, ``_corrupt``,
    the document itself (``_doc``) and ``_bad``, whether it is none.  Works on streams as well."""
    def strip(c):  # ``trim`` removes spaces only; documents may end with newlines
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    body = strip(F.col("value"))
    is_lines = F.exists(F.split(body, "\r?\n"), lambda x: x.rlike(r"^\{.*\}\s*$"))
    docs = F.array(body) if lines else F.when(is_lines, F.split(body, "\n")).otherwise(F.array(body))
    d = texts.select("_file", F.explode(docs).alias("doc")).withColumn("doc", strip(F.col("doc"))).where(F.length("doc") > 0)
    parsed = d.select("_file", F.from_json("doc", RESULT_SCHEMA, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "doc")
    parsed = parsed.select("_file", "r.*", F.col("doc").alias("_doc"))
    bad = F.col("_corrupt").isNotNull() | F.col("experiment_name").isNull() & F.col("_doc").isNotNull() & ~F.col("_doc").startswith("{")
    return parsed.withColumn("_bad", bad)


def summary_table(results: DataFrame) -> DataFrame:
    """One flat row per result with defaults, percent and minutes.

    Fields are read from ``config`` first and from the legacy top level
    second (the reader/writer layouts differ), then defaulted.
    """
    c, ev = F.col("config"), F.col("eval_results")

    def pct(x):
        return F.coalesce(ev[x], F.lit(0.0)) * 100

    return results.select(
        F.coalesce(F.col("experiment_name"), F.lit("")).alias("experiment"),
        F.coalesce(c["peft_method"], F.col("peft_method"), F.lit("")).alias("method"),
        F.coalesce(c["model"], F.col("model"), F.lit("")).alias("model"),
        F.coalesce(c["dataset"], F.col("dataset"), F.lit("")).alias("dataset"),
        F.coalesce(c["epochs"], F.col("epochs"), F.lit(0)).alias("epochs"),
        pct("eval_accuracy").alias("accuracy"), pct("eval_f1").alias("f1"),
        pct("eval_precision").alias("precision"), pct("eval_recall").alias("recall"),
        (F.coalesce(F.col("duration_seconds"), F.lit(0.0)) / 60).alias("duration_min"),
        F.coalesce(c["lora_config"]["r"], F.col("peft_config")["r"]).alias("lora_r"),
        F.col("peft_config")["reduction_factor"].alias("adapter_rf"))


def summary_row(results: DataFrame) -> DataFrame:
    """The 7-column CSV summary row per result."""
    return results.select(
        F.col("experiment_name").alias("experiment"), F.col("config.peft_method").alias("method"),
        F.col("config.dataset").alias("dataset"),
        F.coalesce(F.col("eval_results.eval_accuracy"), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.col("eval_results.eval_f1"), F.lit(0.0)).alias("f1"),
        F.col("model_info.trainable_parameters").alias("trainable_params"),
        (F.col("duration_seconds") / 60).alias("duration_min"))
