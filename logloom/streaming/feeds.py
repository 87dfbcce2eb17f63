"""Streams of session files: deduplicated observations per micro-batch, change feeds, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logloom.operators import dedup
from logloom.operators.preflight import changed
from logloom.sources.tables import split_records


def session_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as (path, text, mtime), each file once."""
    return spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(folder).select("path", F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("mtime"))


def observe_to(stream: DataFrame, table_path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each micro-batch's record observations to a Parquet table, once even after a restart.

    A batch writes to its own partition and overwrites it if it runs again.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = dedup.observations(dedup.record_layer(split_records(batch, "path", "text")))
        seen.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def change_feed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, size, mtime) that are new or changed between two listings."""
    return changed(before, after, "path", ["size", "mtime"])


def namespace_delta(before: DataFrame, after: DataFrame, pending: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, size, mtime): added, changed or removed; else retry.

    ``pending`` names the paths whose last change couldn't be applied: those that haven't changed anew come again.
    """
    b = before.select("path", F.struct("size", "mtime").alias("was"))
    x = b.join(after.select("path", F.struct("size", "mtime").alias("now")), "path", "full")
    x = x.join(pending.select("path", F.lit(True).alias("again")).distinct(), "path", "full")
    change = F.when(F.col("was").isNull() & F.col("now").isNotNull(), "added").when(F.col("was").isNotNull() & F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").when(F.col("again"), "retry")
    return x.select("path", change.alias("change")).where("change IS NOT NULL")


def windowed_counts(events: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Events per tumbling window, those later than ``late`` dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def user_sessions(events: DataFrame, user: str, ts: str, gap: str) -> DataFrame:
    """Each user's activity sessions, ended by ``gap`` without events."""
    return events.groupBy(user, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
