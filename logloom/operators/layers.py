"""Sightings of the field and chunk layers, which need a tokenizer or a rolling hash in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.cdc import Bounds, cdc_chunks
from logloom.functions.jsonbytes import find_string_spans


def field_layer(records: DataFrame, least: int, max_line: int = 32 << 20) -> DataFrame:
    """One sighting per JSON string token of at least ``least`` bytes, raw spelling and quotes included, with its path.

    Records above ``max_line`` bytes and records that don't parse have none.
    """
    # a record shorter than the least token has none, and is spared the tokenizer
    records = records.where(F.octet_length("record") >= least)
    data = F.when(F.octet_length("record") <= max_line, F.to_binary("record", F.lit("utf-8")))
    spans = records.select("session_id", "rec_idx", data.alias("data")).where("data IS NOT NULL").withColumn("found", find_string_spans(least)("data"))
    fields = spans.select("session_id", "rec_idx", "data", F.posexplode("found.spans").alias("i", "s"))
    token = F.substring("data", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return fields.select(
        "session_id", F.lit("field").alias("layer"), F.sha2(token, 256).alias("digest"), (F.col("s.end") - F.col("s.start")).cast("long").alias("size"), F.col("s.path").alias("path"), F.struct("rec_idx", "i").alias("pos")
    )


def cdc_layer(sessions: DataFrame, session: str, data: str, bounds: Bounds) -> DataFrame:
    """One sighting per chunk of a whole session, record boundaries ignored."""
    found = sessions.select(F.col(session).alias("session_id"), F.posexplode(cdc_chunks(bounds)(data)).alias("i", "c"))
    return found.select("session_id", F.lit("cdc").alias("layer"), F.col("c.digest").alias("digest"), (F.col("c.end") - F.col("c.start")).alias("size"), F.lit("").alias("path"), F.col("i").alias("pos"))
