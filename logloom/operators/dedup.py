"""Exact duplicate measurement over three overlapping layers: records, JSON string fields, chunks.

Layers are never added together. An observation is one sighting of a digest and size in a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAYERS = ("cdc", "field", "record")


def normalize_layers(layers: str = "") -> tuple[str, ...]:
    """Comma-separated layer names in canonical order; blank means all; an unknown one, or commas alone, is an error."""
    names = {x.strip().lower() for x in layers.split(",") if x.strip()}
    if not names and layers.strip():
        raise ValueError("no layer is named")
    names = names or set(LAYERS)
    if unknown := sorted(names - set(LAYERS)):
        raise ValueError(f"unknown layers: {', '.join(unknown)}")
    return tuple(x for x in LAYERS if x in names)


def record_layer(records: DataFrame) -> DataFrame:
    """One observation per record, newline included."""
    return records.select("session_id", F.lit("record").alias("layer"), F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("size"), F.lit("").alias("path"), F.col("rec_idx").alias("pos"))


def observations(sightings: DataFrame) -> DataFrame:
    """Sightings counted per session, layer, digest and size, with the path of the first in the session."""
    return sightings.groupBy("session_id", "layer", "digest", "size").agg(F.count("*").alias("occurrences"), F.min_by("path", "pos").alias("sample_path"))


def paths(sightings: DataFrame) -> DataFrame:
    """(path, fields, field_bytes): sightings and their bytes by path. An observation has one path, sightings have all."""
    return sightings.groupBy("path").agg(F.count("*").alias("fields"), F.sum("size").alias("field_bytes"))


def objects(observed: DataFrame) -> DataFrame:
    """One row per layer, digest and size over all sessions; the sample is the least path that isn't empty, else ''."""
    return observed.groupBy("layer", "digest", "size").agg(F.sum("occurrences").alias("occurrences"), F.coalesce(F.min(F.nullif("sample_path", F.lit(""))), F.lit("")).alias("sample_path"))


def layer_stats(observed: DataFrame) -> DataFrame:
    """Objects, unique objects, bytes and duplicates of each layer."""
    size, n = F.col("size"), F.col("occurrences")
    return objects(observed).groupBy("layer").agg(
        F.sum(n).alias("object_count"), F.count("*").alias("unique_objects"), F.sum(size * n).alias("total_bytes"), F.sum(size).alias("unique_bytes"),
        F.sum(n - 1).alias("duplicate_occurrences"), F.sum(size * (n - 1)).alias("duplicate_bytes"),
    )


def top_objects(observed: DataFrame, k: int) -> DataFrame:
    """The ``k`` repeated objects of each layer with most duplicate bytes; none for ``k`` of 0 or less."""
    repeated = objects(observed).where("occurrences > 1").withColumn("duplicate_bytes", F.col("size") * (F.col("occurrences") - 1))
    rank = F.row_number().over(W.partitionBy("layer").orderBy(F.desc("duplicate_bytes"), F.desc("size"), "digest"))
    return repeated.withColumn("rank", rank).where(F.col("rank") <= max(0, k))


def duplicate_records(observed: DataFrame) -> DataFrame:
    """(digest, size, occurrences) of the records seen more than once; keep it as a table for lookups."""
    return observed.where("layer = 'record'").groupBy("digest", "size").agg(F.sum("occurrences").alias("occurrences")).where("occurrences > 1")


def is_duplicate(records: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The records that ``duplicates`` has: a join in place of point lookups."""
    keyed = records.withColumns({"digest": F.sha2("record", 256), "size": F.octet_length("record").cast("long")})
    return keyed.join(duplicates.select("digest", "size"), ["digest", "size"], "left_semi")


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage of a whole; 0 of nothing."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def report(stats: DataFrame, scanned_bytes: Column) -> DataFrame:
    """``layer_stats`` with each layer's share of duplicate bytes in percent, and the row as a line of text and of JSON."""
    r = stats.withColumn("duplicate_percent", F.round(share_percent(F.col("duplicate_bytes"), scanned_bytes), 2))
    text = F.format_string("%s: %d objects, %d unique, %d duplicate bytes (%.2f%%)", "layer", "object_count", "unique_objects", "duplicate_bytes", "duplicate_percent")
    columns = ["layer", "object_count", "unique_objects", "total_bytes", "unique_bytes", "duplicate_occurrences", "duplicate_bytes", "duplicate_percent"]
    return r.select(*columns, text.alias("text"), F.to_json(F.struct(*columns)).alias("json"))


def counters(records: DataFrame, min_field: int, max_line: int, spans: Column | None = None) -> DataFrame:
    """Per session: records, bytes, oversized lines and, given parsed ``spans``, valid and invalid lines and fields.

    Lines above ``max_line`` are never parsed for fields; they count as oversized only where fields are asked for.
    """
    size = F.octet_length("record").cast("long")
    over = size > max_line
    columns = [F.count("*").alias("records"), F.sum(size).alias("scanned_bytes")]
    if spans is not None:
        fields = F.filter(spans["spans"], lambda s: s["end"] - s["start"] >= min_field)
        columns += [
            F.count_if(over).alias("oversized"), F.count_if(~over & (spans["status"] == "ok")).alias("parsed"), F.count_if(~over & (spans["status"] != "ok")).alias("invalid"),
            F.coalesce(F.sum(F.when(~over, F.size(fields))), F.lit(0)).cast("long").alias("fields"),
            F.coalesce(F.sum(F.when(~over, F.aggregate(fields, F.lit(0), lambda a, s: a + (s["end"] - s["start"])))), F.lit(0)).cast("long").alias("field_bytes"),
        ]
    return records.groupBy("session_id").agg(*columns)
