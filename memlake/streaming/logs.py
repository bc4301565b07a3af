"""Append logs as streams: traces, audits, sessions by gap, and retaining by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.sources.schemas import TRACE


def follow(spark: SparkSession, path: str, schema: StructType | str = TRACE, files_per_batch: int = 100) -> DataFrame:
    """New JSON-line files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def daily_counts(events: DataFrame, at: str = "t", by: tuple[str, ...] = ("op",), late: str = "1 hour") -> DataFrame:
    """Events per UTC day and ``by``; a day is final once the watermark (``late``) has passed it."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, "1 day"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *by, "n")


def due_sessions(traces: DataFrame, gap: str = "30 minutes", late: str = "1 hour", min_messages: int = 30, min_minutes: float = 60) -> DataFrame:
    """Sessions that ended by a gap and are due for consolidation: enough messages, long enough."""
    said = traces.where(F.col("kind").isin("user", "agent")).withWatermark("t", late)
    ended = said.groupBy(F.session_window("t", gap).alias("w"), "session_id").agg(F.count("*").alias("n_messages"), F.min("t").alias("started"), F.max("t").alias("ended"))
    minutes = (F.unix_micros("ended") - F.unix_micros("started")) / 60_000_000
    return ended.select("session_id", "started", "ended", "n_messages").where((F.col("n_messages") >= min_messages) & (minutes >= min_minutes))


def append_to(stream: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ()):
    """A query that appends the stream to a Parquet table, exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.partitionBy(*by) if by else writer).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch to a batch operator, such as retaining facts or an audit hook."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
