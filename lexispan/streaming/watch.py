"""Watching a tree of changes: a stream that keeps an index up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.build import latest


def file_changes(spark: SparkSession, root: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """New change files below a root, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(root)


def watch(changes: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, interval: str = "500 milliseconds") -> StreamingQuery:
    """Calls update with the last version of each path in every micro-batch. Batches that come again after a failure carry the same number."""

    def take(batch: DataFrame, n: int) -> None:
        update(latest(batch, "path", ["mtime"], "false"), n)

    writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def running_latest(events: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """The last value of each key so far, as a streaming aggregate (update mode)."""
    return events.groupBy(key).agg(F.max(F.struct(version, value)).alias("r")).select(key, f"r.{version}", f"r.{value}")
