"""Structured Streaming: results arriving file by file (R1), progress counts
with a watermark (R2).

Both sinks are ``foreachBatch`` writers that make each micro-batch's output a
folder named by the batch id, written with overwrite: a batch re-run after a
failure replaces its own output, so the sink is exactly-once with the
checkpoint.  ``Trigger.AvailableNow`` drains what exists and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_bytes: int = 256 << 20,
                max_files: int | None = None) -> DataFrame:
    """A streaming scan of a folder with an explicit schema.

    A micro-batch takes files up to ``max_bytes``, so the number of batches
    follows the data and not the number of files; ``max_files`` bounds the
    files of a batch instead (for tests, or arrival one by one).
    """
    r = spark.readStream.format(fmt).schema(schema)
    r = r.option("maxBytesPerTrigger", max_bytes) if max_files is None else r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def _batch_writer(sink: str, per_batch=None):
    def write(batch: DataFrame, batch_id: int) -> None:
        out = per_batch(batch) if per_batch is not None else batch
        out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return write


def run_available_now(stream: DataFrame, sink: str, checkpoint: str, output_mode: str = "append",
                      per_batch=None) -> None:
    """Drain the source once into ``sink`` (one folder per micro-batch).

    ``per_batch`` transforms each (static) micro-batch before it is written.
    """
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(_batch_writer(sink, per_batch))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def incremental_summary(key: str, value: str):
    """R1, per micro-batch: partial counts and sums per key (the summary grows).

    Returned as a batch function: the partial is computed on the static
    micro-batch, so no streaming state is kept."""
    def partial(batch: DataFrame) -> DataFrame:
        return batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return partial


def merge_partials(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """R1, reading side: the summary is the sum of the micro-batch partials."""
    p = spark.read.parquet(sink)
    return p.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def progress_counts(stream: DataFrame, ts: str, key: str, window: str, delay: str) -> DataFrame:
    """R2: count per (window, key) with a watermark bounding the state."""
    t = F.col(ts).cast("timestamp")
    return (stream.withColumn("_t", t).withWatermark("_t", delay)
                  .groupBy(F.window("_t", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")))


def latest_updates(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """R2, reading side of an update-mode sink: the last value of every key."""
    p = spark.read.parquet(sink)
    return p.groupBy(*keys).agg(F.max_by("n", "batch_id").alias("n"))
