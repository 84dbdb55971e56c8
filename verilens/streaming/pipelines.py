"""Event logs, live counters, windowed analytics and incremental screening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import fingerprint_index
from ..operators.images import append_fingerprints, nearest_papers
from ..session import written
from .limits import sequenced


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Events of each trace into a partitioned JSON log, numbered by the source."""
    rows = events.select("trace_id", "seq", "ts", "type", "payload", F.to_date("ts").alias("day"))
    return (
        rows.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .trigger(availableNow=True)
        .start()
    )


def numbered_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Events of each trace, numbered without gaps, as Parquet by batch.

    A batch replayed after a failure starts from the same counters and overwrites its
    own folder, so that every event is there once and keeps its number.
    ``events(trace_id, ts, event_id, ...)``.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        sequenced(events)
        .writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_counters(events: DataFrame) -> DataFrame:
    """Started, done, skipped and failed steps per trace, with progress."""
    of = lambda s: F.count_if(F.col("type") == s)
    counts = events.groupBy("trace_id").agg(
        of("started").alias("started"), of("done").alias("done"), of("skipped").alias("skipped"), of("error").alias("error")
    )
    finished = F.col("done") + F.col("skipped") + F.col("error")
    return counts.withColumn("progress", F.try_divide(finished, F.col("started")))


def windowed_stats(log: DataFrame, every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Calls, errors and time per tool in tumbling windows; later rows are dropped."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", every), "tool")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(~F.col("ok")).alias("errors"),
            F.sum("duration_ms").alias("total_ms"),
        )
        .select(F.col("window.start").alias("start"), "tool", "calls", "errors", "total_ms")
    )


def sliding_counts(events: DataFrame, width: str = "60 seconds", step: str = "1 second", delay: str = "1 minute") -> DataFrame:
    """Hits per key in sliding windows, the counting form of R1."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, step), "key")
        .agg(F.count(F.lit(1)).alias("hits"))
        .select(F.col("window.start").alias("start"), "key", "hits")
    )


def screen_images(
    images: DataFrame, index_path: str, findings_path: str, checkpoint: str, edges_path: str | None = None
) -> StreamingQuery:
    """Match new images to the fingerprint index and to each other, then add them to it.

    Every near paper goes to ``edges_path`` (by default beside the findings) as
    (hash_a, paper_id, distance), the ranking of the nearest ones to ``findings_path``.
    A batch replayed after a failure writes to the same folders and is not matched to
    what it added before, as only earlier batches of the index are read.
    """
    edges_path = edges_path or f"{findings_path}_edges"

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = written(batch)
        target = f"{edges_path}/batch_id={batch_id}"
        edges = fingerprint_index.batch_edges(rows, index_path, batch_id)
        edges.write.mode("overwrite").parquet(target)
        near = batch.sparkSession.read.schema(edges.schema).parquet(target)
        nearest_papers(rows, near).write.mode("overwrite").parquet(f"{findings_path}/batch_id={batch_id}")
        fingerprint_index.append(rows, index_path, batch_id)

    return (
        images.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


__all__ = [
    "append_fingerprints",
    "append_log",
    "live_counters",
    "numbered_log",
    "screen_images",
    "sliding_counts",
    "windowed_stats",
]
