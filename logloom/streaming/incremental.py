"""Scans that go on where the last one ended, with the same result as a full scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.cdc import Bounds
from logloom.operators import dedup, layers
from logloom.sources.tables import split_records


class RebuildRequired(Exception):
    """What was scanned isn't a prefix of what is there now, or other settings were used."""


def settings_hash(layers: tuple[str, ...], field_bytes: int, max_line: int, bounds: tuple[int, int, int]) -> str:
    import hashlib

    return hashlib.sha256(f"layers={','.join(layers)};field={field_bytes};line={max_line};cdc={','.join(map(str, bounds))}".encode()).hexdigest()


def scan_state(sessions: DataFrame) -> DataFrame:
    """(session_id, size, mtime, prefix, whole_lines) of sessions (session_id, text, mtime): what the next scan must find again."""
    data = F.coalesce("text", F.lit(""))
    return sessions.select("session_id", F.octet_length(data).cast("long").alias("size"), "mtime", F.sha2(data, 256).alias("prefix"), ((data == "") | data.endswith("\n")).alias("whole_lines"))


def plan(sessions: DataFrame, state: DataFrame) -> DataFrame:
    """``sessions`` with ``mode``: skip (same size and mtime), tail (grown), whole (new) or rebuild, and ``known`` bytes.

    Grown sessions must start with the scanned bytes, and those must end with a newline.
    """
    s = state.select("session_id", F.col("size").alias("known"), F.col("mtime").alias("s_mtime"), "prefix", "whole_lines")
    x = sessions.join(s, "session_id", "left")
    data = F.to_binary(F.coalesce("text", F.lit("")), F.lit("utf-8"))
    size = F.octet_length(data).cast("long")
    same_prefix = F.sha2(F.substring(data, F.lit(1), F.col("known").cast("int")), 256) == F.col("prefix")
    mode = (
        F.when(F.col("known").isNull(), "whole").when((size == F.col("known")) & (F.col("mtime") == F.col("s_mtime")), "skip")
        .when((size > F.col("known")) & F.col("whole_lines") & same_prefix, "tail").when((size == F.col("known")) & same_prefix, "skip").otherwise("rebuild")
    )
    return x.withColumn("mode", mode).drop("s_mtime", "prefix", "whole_lines")


def strict(planned: DataFrame) -> DataFrame:
    """The plan, or RebuildRequired if any session needs it."""
    bad = planned.where("mode = 'rebuild'").select("session_id").limit(5).collect()
    if bad:
        raise RebuildRequired(f"sessions changed other than by appending, such as {[r[0] for r in bad]}")
    return planned


def record_tail(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """Record observations after the scan: those known, merged with the tails' and the new sessions'."""
    data = F.to_binary(F.coalesce("text", F.lit("")), F.lit("utf-8"))
    known = F.when(F.col("mode") == "tail", F.col("known")).otherwise(0)
    tails = planned.where("mode IN ('tail', 'whole')").select("session_id", F.substring(data, (known + 1).cast("int"), F.lit(2147483647)).cast("string").alias("tail"))
    fresh = dedup.observations(dedup.record_layer(split_records(tails, "session_id", "tail")))
    both = observed.unionByName(fresh)
    return both.groupBy("session_id", "layer", "digest", "size").agg(F.sum("occurrences").alias("occurrences"), F.first("sample_path").alias("sample_path"))


def sightings_after(planned: DataFrame, layer: str, least: int = 1, bounds: Bounds = Bounds()) -> DataFrame:
    """Sightings of the field or chunk layer in what a scan must read: grown sessions' tails, and new sessions whole.

    Fields don't cross lines, and known bytes end with one, so a tail has its fields by itself. Chunks go on across the
    seam, so a grown session is cut anew from its beginning; ``rescanned`` says whose old chunks to forget.
    """
    data = F.to_binary(F.coalesce("text", F.lit("")), F.lit("utf-8"))
    if layer == "cdc":
        whole = planned.where("mode IN ('tail', 'whole')").select("session_id", data.alias("data"))
        return layers.cdc_layer(whole, "session_id", "data", bounds)
    known = F.when(F.col("mode") == "tail", F.col("known")).otherwise(0)
    tails = planned.where("mode IN ('tail', 'whole')").select("session_id", F.substring(data, (known + 1).cast("int"), F.lit(2147483647)).cast("string").alias("tail"))
    return layers.field_layer(split_records(tails, "session_id", "tail"), least)


def layer_after(planned: DataFrame, observed: DataFrame, layer: str, least: int = 1, bounds: Bounds = Bounds()) -> DataFrame:
    """Observations of the field or chunk layer after the scan, equal to those of a full scan but for sample paths."""
    known = observed.where(F.col("layer") == layer)
    if layer == "cdc":
        known = known.join(planned.where("mode = 'tail'").select("session_id"), "session_id", "left_anti")
    both = known.unionByName(dedup.observations(sightings_after(planned, layer, least, bounds)))
    return both.groupBy("session_id", "layer", "digest", "size").agg(F.sum("occurrences").alias("occurrences"), F.first("sample_path").alias("sample_path"))


def may_prune(incremental: bool, everything: bool, archived_filter: bool, limit: int = 0, byte_cap: int = 0) -> bool:
    """Whether a scan saw enough to tell that sessions vanished: incremental, over all sessions, without filter or limits."""
    return incremental and everything and not archived_filter and limit <= 0 and byte_cap <= 0


def pruned(observed: DataFrame, sessions: DataFrame) -> DataFrame:
    """Observations of the sessions that are still there."""
    return observed.join(sessions.select("session_id"), "session_id", "left_semi")


def changed_during_scan(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session_id) whose size or mtime changed between two listings, or that vanished.

    Listings with a ``prefix`` (the digest of the bytes that were scanned, taken again afterwards) are compared by that too:
    a session that only grew isn't the same one if its beginning changed.
    """
    if "prefix" in before.columns and "prefix" in after.columns:
        now = after.select("session_id", F.struct("size", "mtime", "prefix").alias("now"))
        return before.join(now, "session_id", "left").where(~F.struct("size", "mtime", "prefix").eqNullSafe(F.col("now"))).select("session_id")
    a = after.select("session_id", F.struct("size", "mtime").alias("now"))
    return before.join(a, "session_id", "left").where(~F.struct("size", "mtime").eqNullSafe(F.col("now"))).select("session_id")


def recovered(journal: DataFrame) -> DataFrame:
    """(operation, phase, action) of each operation's last journal entry, in the order of those: published ones complete, prepared ones roll back."""
    last = journal.groupBy("operation").agg(F.max_by("phase", "seq").alias("phase"), F.max("seq").alias("seq"))
    action: Column = F.when(F.col("phase") == "published", "complete").when(F.col("phase") == "prepared", "roll_back").otherwise("none")
    return last.select("operation", "phase", action.alias("action"), "seq").orderBy("seq")
