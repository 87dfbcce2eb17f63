"""Checks before files are trusted: line validity, fingerprints of windows, snapshots, and health reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.jsonbytes import json_valid

WINDOW = 64 << 10
REQUIRED = 11  # components that a health report must have


def line_issues(records: DataFrame) -> DataFrame:
    """(session_id, line, issue) of every record without final newline, with bad UTF-8, or not JSON; lines count from 1."""
    data = F.to_binary("record", F.lit("utf-8")) if dict(records.dtypes)["record"] == "string" else F.col("record")
    r = records.select("session_id", (F.col("rec_idx") + 1).alias("line"), data.alias("data")).withColumn("json", json_valid()("data"))
    last = F.substring("data", -1, 1)
    issue = F.when(last != F.lit(b"\n"), "no_newline").when(~F.is_valid_utf8(F.col("data").cast("string")), "invalid_utf8").when(~F.col("json"), "invalid_json")
    return r.select("session_id", "line", issue.alias("issue")).where("issue IS NOT NULL")


def first_issue(records: DataFrame) -> DataFrame:
    return line_issues(records).groupBy("session_id").agg(F.min("line").alias("line"), F.min_by("issue", "line").alias("issue"))


def complete_jsonl(records: DataFrame) -> DataFrame:
    """(session_id, complete) of sessions with records: all lines whole and valid."""
    ids = records.select("session_id").distinct()
    return ids.join(line_issues(records).select("session_id", F.lit(False).alias("ok")).distinct(), "session_id", "left").select("session_id", F.coalesce("ok", F.lit(True)).alias("complete"))


def window_fingerprint(data: Column, window: int = WINDOW) -> Column:
    """Digests of a file's first and last ``window`` bytes."""
    n = F.octet_length(data)
    return F.struct(F.sha2(F.substring(data, F.lit(1), F.lit(window)), 256).alias("head"), F.sha2(F.substring(data, F.greatest(n - window + 1, F.lit(1)), F.lit(window)), 256).alias("tail"))


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``after`` that are new or differ in ``columns``; vanished rows are not told."""
    b = before.select(F.col(key), F.struct(*columns).alias("__was"))
    return after.join(b, key, "left").where(~F.struct(*columns).eqNullSafe(F.col("__was"))).drop("__was")


def scan_modes(sessions: DataFrame, cache: DataFrame) -> DataFrame:
    """(cached, incremental, full): unchanged sessions, grown ones with the same head, and the rest."""
    c = cache.select("session_id", F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"), F.col("head").alias("c_head"))
    x = sessions.join(c, "session_id", "left")
    same = (F.col("size") == F.col("c_size")) & (F.col("mtime") == F.col("c_mtime"))
    grown = (F.col("size") > F.col("c_size")) & (F.col("head") == F.col("c_head"))
    mode = F.when(same, "cached").when(grown, "incremental").otherwise("full")
    return x.select(mode.alias("mode")).agg(*[F.count_if(F.col("mode") == m).alias(m) for m in ("cached", "incremental", "full")])


def health(checks: DataFrame, required: list[str]) -> DataFrame:
    """(component, level) and overall health: required components that are missing or doubled, or fail, are errors; failing others warnings.

    ``checks`` has component, ok, blocking. Healthy means no error.
    """
    spark = checks.sparkSession
    wanted = spark.createDataFrame([(c,) for c in required], "component string")
    n = checks.groupBy("component").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"), F.bool_or("blocking").alias("blocking"))
    x = wanted.withColumn("wanted", F.lit(True)).join(n, "component", "full")
    level = F.when(F.col("n").isNull() | (F.col("n") > 1), "error").when(F.col("ok"), "ok").when(F.col("blocking"), "error").otherwise("warning")
    from pyspark.sql import Window as W

    return x.select("component", level.alias("level")).withColumn("healthy", F.bool_and(F.col("level") != "error").over(W.partitionBy()))
