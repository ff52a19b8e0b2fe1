"""Structured Streaming over the change log: dedup by key, then one incremental pass a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.changelog import delta
from ..schema import CHANGE_DDL


def change_stream(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """The log entries that arrive as Parquet files under path, each dedup_key once.

    The watermark bounds what dedup remembers: replays later than an hour are for the batch append to catch.
    """
    reader = spark.readStream.schema(CHANGE_DDL)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withWatermark("created_at", "1 hour").dropDuplicatesWithinWatermark(["dedup_key"])


def on_changes(changes: DataFrame, checkpoint: str, act: Callable[[DataFrame, list[str]], None], *, available_now: bool = True) -> StreamingQuery:
    """act(net changes, relations touched) for each micro-batch that leaves a net change; the checkpoint is the cursor."""

    def each(batch: DataFrame, _: int) -> None:
        net = delta(batch).persist()
        relations = sorted(r["rel"] for r in net.where("rel <> ''").select("rel").distinct().collect())
        if relations:
            act(net, relations)
        net.unpersist()

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def relation_activity(changes: DataFrame, width: str = "10 minutes") -> DataFrame:
    """(window, rel, event_type, n): entries by event-time window; late entries count until the watermark passes."""
    return changes.groupBy(F.window("created_at", width), "rel", "event_type").agg(F.count("*").alias("n"))
