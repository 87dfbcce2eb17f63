"""Inputs as the engine's model: sessions of records, session catalogs, spawn edges, listings.

A record is a line with its newline; a last line without one is a record too; no bytes are no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "title", "cwd", "rollout_path", "model_provider", "model", "git_branch")]
    + [T.StructField("updated_at", T.LongType()), T.StructField("archived", T.BooleanType())]
)
EDGES = T.StructType([T.StructField(c, T.StringType()) for c in ("parent_id", "child_id", "status")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_records(sessions: DataFrame, session: str, text: str) -> DataFrame:
    """(session_id, rec_idx, record) of every record of every session; a null text has none."""
    pieces = sessions.select(F.col(session).alias("session_id"), F.split(text, "\n", -1).alias("pieces"))
    rows = pieces.select("session_id", F.size("pieces").alias("n"), F.posexplode("pieces").alias("i", "piece"))
    last = F.col("i") == F.col("n") - 1
    rows = rows.where(~(last & (F.col("piece") == "")))
    return rows.select("session_id", F.col("i").cast("long").alias("rec_idx"), F.when(last, F.col("piece")).otherwise(F.concat("piece", F.lit("\n"))).alias("record"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_records(table(spark, sf_dir, "documents"), "doc_id", "text")


def json_string(text: Column) -> Column:
    """A JSON string token: backslash, quote and newline escaped (other control characters must not occur)."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as one record of a message in a session of its conversation."""
    t = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    record = F.concat(
        F.lit('{"type":"response_item","timestamp":"2026-01-01T00:'), F.lpad((F.col("turn") % 3600 / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"),
        F.lit('Z","payload":{"type":"message","role":'), json_string(F.coalesce("role", F.lit(""))), F.lit(',"text":'), json_string(F.coalesce("text", F.lit(""))), F.lit("}}\n"),
    )
    return t.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("rec_idx"), record.alias("record"))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a session of one record."""
    record = F.concat(F.lit('{"url":'), json_string(F.coalesce("url", F.lit(""))), F.lit(',"html":'), json_string(F.coalesce("html", F.lit(""))), F.lit("}\n"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("session_id"), F.lit(0).cast("long").alias("rec_idx"), record.alias("record"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a session catalog: every third archived, titled by source."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("lang").alias("cwd"), F.concat(F.lit("/sessions/"), F.col("doc_id").cast("string"), F.lit(".jsonl")).alias("rollout_path"),
        F.col("doc_id").alias("updated_at"), (F.col("doc_id") % 3 == 0).alias("archived"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
    )


def spawn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest over conversations: the parent is half the id; every seventh edge is missing."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").where("conv_id > 0").distinct()
    return ids.where("conv_id % 7 <> 3").select(F.expr("conv_id div 2").alias("parent_id"), F.col("conv_id").alias("child_id"), F.when(F.col("conv_id") % 2 == 0, "open").otherwise("closed").alias("status"))


def sqlite_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The session catalog of an SQLite file, newest first; nulls of optional columns become empty."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute(
            "SELECT id, title, cwd, rollout_path, model_provider, coalesce(model, ''), coalesce(git_branch, ''), updated_at, archived FROM threads ORDER BY updated_at DESC"
        ).fetchall()
    return spark.createDataFrame([(*r[:7], int(r[7]), r[8] != 0) for r in rows], CATALOG)


def sqlite_edges(spark: SparkSession, path: str) -> DataFrame:
    """Spawn edges of an SQLite file; a file without that table has none."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        if not db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table' AND name = 'thread_spawn_edges'").fetchone()[0]:
            return spark.createDataFrame([], EDGES)
        rows = db.execute("SELECT parent_thread_id, child_thread_id, status FROM thread_spawn_edges ORDER BY 1, 2, 3").fetchall()
    return spark.createDataFrame(rows, EDGES)


def binary_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Files as sessions: (session_id, data, size, mtime); the id is the file's name without its ending."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("session_id"), F.col("path").alias("rollout_path"), F.col("content").alias("data"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
