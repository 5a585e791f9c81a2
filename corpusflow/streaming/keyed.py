"""Streams with state: result files by experiment (R1), progress at every hundredth step (R2)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusflow.sources.results import parse_documents

KINDS = ("result", "corrupt")


def result_stream(spark: SparkSession, path: str, lines: bool = False, max_bytes: int = 256 << 20) -> DataFrame:
    """Result files of a folder as they arrive (R1): one row per document, with ``kind`` ``result`` or ``corrupt``.

    A result is known by its experiment and timestamp, a document that is none by its text.  What is delivered
    again, in the same micro-batch or any later one, is dropped by the state of a streaming ``dropDuplicates``; the
    first delivery stays.  The state holds one key a document.
    """
    t = (spark.readStream.format("text").schema("value string").option("wholetext", not lines)
         .option("maxBytesPerTrigger", max_bytes).load(path).withColumn("_file", F.col("_metadata.file_path")))
    parsed = parse_documents(t, lines)
    own = F.to_json(F.struct("experiment_name", "timestamp"))
    key = F.when(F.col("_bad"), F.concat(F.lit("corrupt "), F.md5(F.col("_doc").cast("binary")))).otherwise(F.concat(F.lit("result "), own))
    kind = F.when(F.col("_bad"), KINDS[1]).otherwise(KINDS[0])
    return parsed.withColumn("kind", kind).withColumn("_key", key).drop("_bad", "_corrupt").dropDuplicates(["_key"]).drop("_key")


def ingest_results(spark: SparkSession, path: str, sink: str, checkpoint: str, lines: bool = False, max_bytes: int = 256 << 20) -> None:
    """Take in what has arrived since the last run: a folder a micro-batch, with results and corrupt documents apart.

    A micro-batch that runs again after a failure replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{sink}/batch_id={batch_id}")

    q = (result_stream(spark, path, lines, max_bytes).writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def ingested(spark: SparkSession, sink: str, kind: str = "result") -> DataFrame:
    """What ``ingest_results`` has taken in so far; the filter reads one kind's folders only."""
    return spark.read.option("basePath", sink).parquet(sink).where(F.col("kind") == kind)


STATE = "n long, last timestamp"


def progress_every(stream: DataFrame, key: str, every: int = 100, ts: str | None = None, delay: str = "1 hour",
                   idle_ms: int | None = None) -> DataFrame:
    """One row ``(key, step, closing)`` at each ``every``-th event of a key (R2), in whatever order events arrive.

    Tasks count the events of a key before they are dealt by key, so a busy key sends a row a batch of Arrow and
    not a row an event.  The state of a key is its count.  With ``idle_ms`` (and the event time ``ts``) a timer
    closes a key once the watermark is that far beyond its last event: a row with its last step and ``closing``
    true, after which its state is gone and it begins anew.  Events behind the watermark (at first: not after the
    beginning of 1970) are late and not counted then; without ``idle_ms`` none is late.
    """
    kind = stream.schema[key].dataType.simpleString()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.groupby("key", dropna=False, as_index=False).agg(n=("key", "size"), last=("last", "max"))

    def advance(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, last = state.get if state.exists else (0, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "step": [before], "closing": [True]})
            return
        n = before
        for f in frames:
            n += int(f["n"].sum())
            some = f["last"].max()
            last = last if pd.isna(some) else some if last is None else max(pd.Timestamp(last), some)
        state.update((n, last))
        if idle_ms is not None and last is not None:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        steps = list(range(every * (before // every + 1), n + 1, every))
        yield pd.DataFrame({"key": [k[0]] * len(steps), "step": steps, "closing": [False] * len(steps)})

    last = F.col(ts).cast("timestamp") if ts is not None else F.lit(None).cast("timestamp")
    counts = stream.select(F.col(key).alias("key"), last.alias("last")).mapInPandas(count, f"key {kind}, n long, last timestamp")
    if idle_ms is not None:
        counts = counts.withWatermark("last", delay)
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    out = counts.groupBy("key").applyInPandasWithState(advance, f"key {kind}, step long, closing boolean", STATE, "append", timeout)
    return out.withColumnRenamed("key", key)
