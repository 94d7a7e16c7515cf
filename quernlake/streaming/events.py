"""Structured Streaming over event tables: windows with watermarks, sessions, first-seen rows, latest state by key, live results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import changes, reset


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 16) -> DataFrame:
    """A stream of the Parquet files under a path, with the schema that they have now.

    Files are taken by their time of change. Where that is not the order of events within the watermark, rows of later batches are dropped as late;
    files_per_trigger = None puts all files that there are into one batch, in which no row is late.
    """
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    return (stream if files_per_trigger is None else stream.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def tumbling(events: DataFrame, time: str, length: str, lateness: str, keys: list[str], *aggregates) -> DataFrame:
    """Aggregates by window of `length` and keys; rows later than `lateness` are dropped, as the watermark says."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.groupBy(F.window(time, length), *keys).agg(*aggregates).select("window.start", "window.end", *keys, *_names(aggregates))


def sliding(events: DataFrame, time: str, length: str, slide: str, lateness: str, keys: list[str], *aggregates) -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.groupBy(F.window(time, length, slide), *keys).agg(*aggregates).select("window.start", "window.end", *keys, *_names(aggregates))


def sessions(events: DataFrame, time: str, gap: str, lateness: str, keys: list[str], *aggregates) -> DataFrame:
    """Aggregates by session: runs of events of the keys with gaps of less than `gap`."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.groupBy(F.session_window(time, gap), *keys).agg(*aggregates).select("session_window.start", "session_window.end", *keys, *_names(aggregates))


def first_seen(events: DataFrame, time: str, lateness: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def _names(aggregates) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2].strip("`") for a in aggregates]


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that there is now, write it as Parquet, and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def live_changes(stream: DataFrame, result: Callable[[], DataFrame], key: str, snapshots: str, callback: Callable[[DataFrame], None], checkpoint: str, order: list[str] | None = None) -> StreamingQuery:
    """After each batch of a stream of commits, the changes of a result since the batch before.

    result() gives the result as it is now; it is written as a snapshot under `snapshots`, so the difference is taken between two tables on disk, on executors,
    and only the changes reach the callback. The first batch changes nothing into all rows. A batch that is run again after a failure overwrites its
    own snapshot and gives the same changes. If the snapshot before is lost, the feed says so: a RESET, then all rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        result().write.mode("overwrite").parquet(f"{snapshots}/{number}")
        now = spark.read.parquet(f"{snapshots}/{number}")
        if not number:
            return callback(changes(now.where("false"), now, key, order))
        try:
            before = spark.read.parquet(f"{snapshots}/{number - 1}")
        except AnalysisException:  # no such path
            return callback(reset(now, key, order))
        return callback(changes(before, now, key, order))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
