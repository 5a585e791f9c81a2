"""Streaming queries (R1-R2): the streamed result must equal the batch one."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.plans.q_analytics import RUNS_SQL, results
from corpusflow.plans.registry import query
from corpusflow.session import scratch_dir
from corpusflow.sources.tables import Tables
from corpusflow.streaming import keyed as K
from corpusflow.streaming import stream as ST


def _event_files(spark, d):
    """Write the events as one folder per day: the files that 'arrive'."""
    src = scratch_dir(spark, "events-in")
    e = Tables(spark, d).events.withColumn("day", F.to_date("ts"))
    e.write.partitionBy("day").parquet(src)
    return src, e.schema


@query("stream_summary", """
SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 6) AS total_value FROM events GROUP BY event_type""")
def stream_summary(spark, d):
    src, schema = _event_files(spark, d)
    sink, ckpt = scratch_dir(spark, "summary-sink"), scratch_dir(spark, "summary-ckpt")
    s = ST.file_stream(spark, src, schema)
    ST.run_available_now(s, sink, ckpt, "append", per_batch=ST.incremental_summary("event_type", "value"))
    m = ST.merge_partials(spark, sink, "event_type")
    return m.select("event_type", "n", F.round("total", 6).alias("total_value"))


@query("stream_progress", """
SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, COUNT(*) AS n FROM events GROUP BY 1, 2""")
def stream_progress(spark, d):
    src, schema = _event_files(spark, d)
    sink, ckpt = scratch_dir(spark, "progress-sink"), scratch_dir(spark, "progress-ckpt")
    s = ST.file_stream(spark, src, schema)
    # files may arrive in any order, so no row is late within the span of the data
    span = spark.read.parquet(src).agg(F.date_diff(F.max("ts"), F.min("ts"))).first()[0] or 0
    agg = ST.progress_counts(s, "ts", "event_type", "1 day", f"{span + 2} days")
    ST.run_available_now(agg.select("event_type", F.col("w.start").alias("ws"), "n"), sink, ckpt, "update")
    r = ST.latest_updates(spark, sink, ["event_type", "ws"])
    return r.select("event_type", F.date_format("ws", "yyyy-MM-dd").alias("day"), "n")


def _ingested(spark, d, kind):
    """Result files in two deliveries.  In the first, every seventh run's document is cut off in the middle; the
    second brings all documents, so that most arrive again."""
    src, sink, ckpt = (scratch_dir(spark, f"results-{x}") for x in ("in", "sink", "ckpt"))
    docs = results(spark, d).select(F.to_json("result").alias("doc"), (F.col("result.model_info.trainable_parameters") % 700 == 0).alias("cut"))
    docs.select(F.when(F.col("cut"), F.substring("doc", 1, 60)).otherwise(F.col("doc")).alias("value")).write.text(f"{src}/first")
    K.ingest_results(spark, f"{src}/*", sink, ckpt, lines=True)
    docs.select(F.col("doc").alias("value")).write.text(f"{src}/second")
    K.ingest_results(spark, f"{src}/*", sink, ckpt, lines=True)
    return K.ingested(spark, sink, kind)


@query("stream_results", f"""WITH {RUNS_SQL}
SELECT experiment_name, method, ROUND(acc, 6) AS accuracy, ROUND(f1, 6) AS f1 FROM runs""")
def stream_results(spark, d):
    """Results that come file by file, some of them twice, each counted once."""
    g = _ingested(spark, d, "result")
    return g.select("experiment_name", F.col("config.peft_method").alias("method"),
                    F.round("eval_results.eval_accuracy", 6).alias("accuracy"), F.round("eval_results.eval_f1", 6).alias("f1"))


@query("stream_results_corrupt", f"""WITH {RUNS_SQL}
SELECT left('{{"experiment_name":"' || experiment_name || '","timestamp":"', 60) AS begins, COUNT(*) AS n
FROM runs WHERE n % 7 = 0 GROUP BY experiment_name""")
def stream_results_corrupt(spark, d):
    """Documents that were cut off are kept apart from the results, each once."""
    b = _ingested(spark, d, "corrupt")
    return b.groupBy(F.regexp_extract("_doc", r'^\{"experiment_name":"[^"]*","timestamp":"', 0).alias("begins")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_progress_steps", """
SELECT event_type, step FROM (SELECT event_type, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events)
WHERE step % 100 = 0""")
def stream_progress_steps(spark, d):
    """R2: a row at every hundredth event of a type; the events come in two deliveries, in shuffled order."""
    src = scratch_dir(spark, "steps-in")
    sink, ckpt = scratch_dir(spark, "steps-sink"), scratch_dir(spark, "steps-ckpt")
    e = Tables(spark, d).events.select("event_id", "event_type", "ts")
    second = F.crc32(F.col("event_id").cast("string").cast("binary")) % 2 == 0
    for part in (e.where(~second), e.where(second)):
        part.repartition("event_id").write.mode("append").parquet(src)
        steps = K.progress_every(ST.file_stream(spark, src, e.schema), "event_type", 100)
        ST.run_available_now(steps, sink, ckpt, "append")
    return spark.read.parquet(sink).select("event_type", "step")
