"""Work that comes round: enrollment cycles, compaction, and refreshed routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logloom.operators import enroll
from logloom.sources import stores


def enrollment_cycle(sessions: DataFrame, managed: DataFrame, writers: DataFrame, observations: str, policy: enroll.Policy, gates: enroll.Gates = enroll.Gates(), budget: enroll.Budget | None = enroll.Budget()) -> DataFrame:
    """One cycle: decide from the last cycle's observations, then save this one's; returns the decisions.

    Stability thus counts over cycles: a session must look the same to as many as its quiet time takes. Observations
    are replaced only once the decisions are made, so a cycle that fails is made again from the same state.
    """
    from logloom.sources.shared import stage

    spark = sessions.sparkSession
    previous = stores.load_observations(spark, observations)
    decided = stage(enroll.decisions(sessions, previous, managed, writers, policy, gates, budget), "decisions")
    seen = stage(enroll.observed(sessions, previous, policy).select(F.col("id").alias("session_id"), F.col("rollout_path").alias("path"), "size", "mtime", "stable_since"), "observations")
    stores.save_observations(seen, observations)
    return decided


def every(spark: SparkSession, seconds: float, cycle: Callable[[int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that calls ``cycle`` once per interval, with a number that goes on after a restart.

    The ticks come from Spark's rate source; a cycle that takes longer than the interval delays the next.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, number: cycle(number)).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint)


def routes_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session_id, change) between two route tables (session_id, generation): added, removed or moved."""
    x = before.select("session_id", F.col("generation").alias("was")).join(after.select("session_id", F.col("generation").alias("now")), "session_id", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "moved")
    return x.select("session_id", change.alias("change")).where("change IS NOT NULL")


def compactable(states: DataFrame, writers: DataFrame, now: int, idle: int) -> DataFrame:
    """The sessions with a delta or backing that nobody writes and that have been still for ``idle`` seconds."""
    pending = states.where("delta IS NOT NULL OR backing IS NOT NULL").where(F.col("mtime") <= now - idle)
    return pending.join(writers.select("session_id"), "session_id", "left_anti")


def compacted(states: DataFrame, generations: DataFrame) -> DataFrame:
    """The next generation of each state: what it shows becomes its base, without delta or backing, and is verified.

    ``generations`` is (session_id, generation); a session without one begins at 1. ``verified`` says whether the new
    base reads back as the old view did; only then may the pointer be swapped.
    """
    from logloom.operators import pack

    shown = pack.visible(states).select("session_id", F.col("data").alias("base"), "size")
    x = shown.join(generations.select("session_id", "generation"), "session_id", "left")
    x = x.select("session_id", (F.coalesce("generation", F.lit(0)) + 1).alias("generation"), "base", F.lit(None).cast("binary").alias("delta"), F.lit(None).cast("binary").alias("backing"), F.sha2("base", 256).alias("sha256"), "size")
    again = pack.visible(x).select("session_id", F.sha2("data", 256).alias("back"), F.col("size").alias("n"))
    return x.join(again, "session_id").withColumn("verified", (F.col("back") == F.col("sha256")) & (F.col("n") == F.col("size"))).drop("back", "n")
