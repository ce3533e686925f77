"""Runs that go on where they stopped, and windowed run statistics, as structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resume(spark: SparkSession, source: str, schema, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Processes the files that have come since the last run, each batch once, and stops.

    A batch writes its own folder, so a repeated batch replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means by window and kind; on a stream, rows later than ``late`` are left out."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    grouped = marked.groupBy(F.window(time, size).alias("w"), kind)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), kind, "n", "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key, closed after a gap."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")
