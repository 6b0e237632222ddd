"""Streams of files and log rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_rows(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None, pattern: str = "*") -> DataFrame:
    """Files that have not been read yet; the checkpoint of the query is the ledger."""
    r = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).load(path)


def once(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each key once, within the delay of the watermark; state older than that is let go."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, at: str, keys: list[str], length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by window (an extension: the look-back counts of the monitor, for any stretch of time)."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, delay).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """Rows of one key without a longer gap form a session (an extension)."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def paired_steps(starts: DataFrame, ends: DataFrame, key: str, at: str, within: str, delay: str = "1 hour") -> DataFrame:
    """Starts with their completions, by a join of two streams within a time bound."""
    s = starts.withWatermark(at, delay).select(F.col(key).alias("k"), F.col(at).alias("begin"))
    e = ends.withWatermark(at, delay).select(F.col(key).alias("k2"), F.col(at).alias("end"))
    return s.join(e, F.expr(f"k = k2 AND end >= begin AND end <= begin + INTERVAL {within}")).select(F.col("k").alias(key), "begin", "end")


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything there is now, then stop; a later call goes on where this one ended."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def follow(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str = "30 seconds", mode: str = "append") -> StreamingQuery:
    """What comes, looked for at an interval, until the query is stopped.  Empty looks cost
    nothing but a listing; ``monitoring.poll_interval`` tells how far to space them."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(processingTime=every).start()
