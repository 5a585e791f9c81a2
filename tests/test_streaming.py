"""Streams: a drained stream re-run on its checkpoint adds nothing, and a
replayed micro-batch replaces its own output (exactly-once sink)."""

from pyspark.sql import functions as F

from corpusflow.session import scratch_dir
from corpusflow.streaming import stream as ST

from driver_tables import SF001


def test_stream_summary_is_idempotent(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").withColumn("day", F.to_date("ts"))
    src = scratch_dir(spark, "t-stream-in")
    ev.write.partitionBy("day").parquet(src)
    sink, ckpt = scratch_dir(spark, "t-stream-sink"), scratch_dir(spark, "t-stream-ckpt")
    part = ST.incremental_summary("event_type", "value")
    for _ in range(2):  # the second run finds nothing new in the checkpoint
        ST.run_available_now(ST.file_stream(spark, src, ev.schema), sink, ckpt, "append", per_batch=part)
    got = {r.event_type: r.n for r in ST.merge_partials(spark, sink, "event_type").collect()}
    exp = {r.event_type: r["count"] for r in ev.groupBy("event_type").count().collect()}
    assert got == exp
    # replaying a batch id overwrites that batch's folder instead of adding to it
    writer = ST._batch_writer(sink, part)
    batch = spark.read.parquet(src).limit(10)
    writer(batch, 0)
    writer(batch, 0)
    again = spark.read.parquet(f"{sink}/batch_id=0").agg(F.sum("n")).collect()[0][0]
    assert again == 10
