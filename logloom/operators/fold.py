"""Lossless decomposition of sessions into ordered content-addressed parts, and everything read back from them.

Large string tokens become field parts; all bytes between them are one residual stream per stretch, cut into
chunks that go on across records. A session is folded by one call on its bytes, as its parts are sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.cdc import Bounds, cuts
from logloom.functions.jsonbytes import INVALID, spans


class FoldSettings(NamedTuple):
    field_bytes: int = 4 << 10
    bounds: Bounds = Bounds(4 << 10, 16 << 10, 64 << 10)
    max_line: int = 32 << 20
    record_bytes: int = 0  # records this large may be promoted to parts of their own; 0: never


def split_parts(data: bytes, settings: FoldSettings, promoted: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, int, int]]:
    """(kind, path, start, end) of the parts that make up ``data``, in order."""
    residual, at = 0, 0

    def flush(stop: int) -> Iterator[tuple[str, str, int, int]]:
        start = residual
        for end in cuts(data[residual:stop], settings.bounds):
            yield "residual", "", start, residual + end
            start = residual + end

    while at < len(data):
        stop = data.find(b"\n", at) + 1 or len(data)
        line = data[at:stop]
        if settings.record_bytes and len(line) >= settings.record_bytes and hashlib.sha256(line).hexdigest() in promoted:
            yield from flush(at)
            yield "record", "", at, stop
            residual = stop
        else:
            status, found = (INVALID, []) if len(line) > settings.max_line else spans(line, settings.field_bytes)
            for path, start, end in found:
                yield from flush(at + start)
                yield "field", path, at + start, at + end
                residual = at + end
        at = stop
    yield from flush(len(data))


def fold_parts(sessions: DataFrame, session: str, data: str, settings: FoldSettings = FoldSettings(), promoted: frozenset[str] = frozenset()) -> DataFrame:
    """(session_id, part_idx, kind, json_path, start, raw_bytes, sha256, stored_bytes, bytes) of every part of every session.

    ``stored_bytes`` is the zstd size at the default level. Promotion digests must be few enough to send along.
    """
    rows = sessions.select(F.col(session).alias("session_id"), F.col(data).cast("binary").alias("data"))
    id_type = rows.schema["session_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor()
        for batch in batches:
            for sid, blob in zip(batch["session_id"], batch["data"], strict=True):
                raw = blob.as_py() or b""
                parts = list(split_parts(raw, settings, promoted))
                pieces = [raw[a:b] for _, _, a, b in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sid.as_py()] * len(parts), batch.schema.field("session_id").type), pa.array(range(len(parts)), pa.int64()), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array([p[2] for p in parts], pa.int64()), pa.array([len(p) for p in pieces], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string()), pa.array([len(compressor.compress(p)) for p in pieces], pa.int64()), pa.array(pieces, pa.binary())],
                    names=["session_id", "part_idx", "kind", "json_path", "start", "raw_bytes", "sha256", "stored_bytes", "bytes"],
                )

    return rows.mapInArrow(fold, f"session_id {id_type}, part_idx long, kind string, json_path string, start long, raw_bytes long, sha256 string, stored_bytes long, bytes binary")


def promotions(records: DataFrame, duplicates: DataFrame, settings: FoldSettings, known: DataFrame | None = None) -> DataFrame:
    """(digest) of the records to store whole: large, repeated, of several components, and no dearer than half of them.

    A record already stored, or whose stored size is at most half of its new components' together, qualifies.
    """
    rows = records.select(F.to_binary("record", F.lit("utf-8")).alias("data"), F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("size"))
    rows = rows.where(F.col("size") >= settings.record_bytes).join(duplicates.select("digest", "size"), ["digest", "size"], "left_semi").dropDuplicates(["digest"])
    parts = fold_parts(rows, "digest", "data", settings._replace(record_bytes=0))
    whole = fold_parts(rows, "digest", "data", settings._replace(record_bytes=1, field_bytes=1 << 62, bounds=Bounds(1 << 30, 1 << 30, 1 << 30))).groupBy("session_id").agg(F.sum("stored_bytes").alias("whole_bytes"))
    stored = parts.select("sha256").limit(0) if known is None else known.select("sha256")
    fresh = parts.join(stored.withColumn("there", F.lit(True)).distinct(), "sha256", "left").withColumn("new", F.when(F.col("there").isNull(), F.col("stored_bytes")).otherwise(0))
    cost = fresh.dropDuplicates(["session_id", "sha256"]).groupBy("session_id").agg(F.sum("new").alias("new_bytes"))
    several = parts.groupBy("session_id").agg(F.count("*").alias("components")).where("components > 1")
    own = stored.select(F.col("sha256").alias("session_id"), F.lit(True).alias("own")).distinct()
    choice = several.join(whole, "session_id").join(cost, "session_id").join(own, "session_id", "left")
    return choice.where(F.coalesce("own", F.lit(False)) | (F.col("whole_bytes") <= F.expr("new_bytes div 2"))).select(F.col("session_id").alias("digest"))


def unfold(parts: DataFrame) -> DataFrame:
    """(session_id, data): the parts' bytes concatenated in order. Sessions without parts (empty ones) don't appear."""
    return parts.groupBy("session_id").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY part_idx)").alias("data"))


def verify(parts: DataFrame, sessions: DataFrame, session: str, data: str) -> DataFrame:
    """(session_id, raw_bytes, verified): whether length and digest of the unfolded bytes equal the source's."""
    source = sessions.select(F.col(session).alias("session_id"), F.sha2(F.coalesce(F.col(data).cast("binary"), F.lit(b"")), 256).alias("digest"), F.coalesce(F.octet_length(data), F.lit(0)).cast("long").alias("raw_bytes"))
    back = unfold(parts).select("session_id", F.sha2("data", 256).alias("back"), F.octet_length("data").cast("long").alias("n"))
    empty = F.sha2(F.lit(b""), 256)
    return source.join(back, "session_id", "left").select("session_id", "raw_bytes", ((F.coalesce("back", empty) == F.col("digest")) & (F.coalesce("n", F.lit(0)) == F.col("raw_bytes"))).alias("verified"))


def reuse(parts: DataFrame) -> DataFrame:
    """(kind, parts, unique, reused, unique_raw_bytes, new_stored_bytes): a digest's first part by session and index is unique.

    Counts per digest and kind are added up before digests are shuffled, so a part that is everywhere costs one row per task.
    """
    first = F.min(F.struct("session_id", "part_idx", "raw_bytes", "stored_bytes"))
    own = parts.groupBy("sha256", "kind").agg(first.alias("first"), F.count("*").alias("n"))
    least = own.groupBy("sha256").agg(F.min(F.struct("first", "kind")).alias("least"), F.collect_list(F.struct("kind", "n")).alias("kinds"))  # at most one row per kind
    counted = least.select("least", F.inline("kinds")).withColumn("is_first", F.col("least.kind") == F.col("kind"))
    return counted.groupBy("kind").agg(
        F.sum("n").alias("parts"), F.count_if("is_first").alias("unique"), (F.sum("n") - F.count_if("is_first")).alias("reused"),
        F.coalesce(F.sum(F.when(F.col("is_first"), F.col("least.first.raw_bytes"))), F.lit(0)).alias("unique_raw_bytes"),
        F.coalesce(F.sum(F.when(F.col("is_first"), F.col("least.first.stored_bytes"))), F.lit(0)).alias("new_stored_bytes"),
    )


def put_objects(parts: DataFrame, store: str) -> DataFrame:
    """Add the parts' objects that the store lacks, each once; returns (sha256, raw_bytes, stored_bytes) of the added.

    Objects already there are verified by their digest and left as they are.
    """
    spark = parts.sparkSession
    new = parts.select("sha256", "raw_bytes", "stored_bytes", "bytes").dropDuplicates(["sha256"])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        have = spark.read.parquet(store)
        wrong = F.sha2("bytes", 256) != F.col("sha256")
        checked = have.select(F.when(wrong, F.raise_error(F.concat(F.lit("damaged object "), F.col("sha256"))).cast("string")).otherwise(F.col("sha256")).alias("sha256"))
        new = new.join(checked, "sha256", "left_anti")
    from logloom.sources.shared import stage

    new = stage(new, "objects")
    new.write.mode("append").option("compression", "zstd").parquet(store)
    return new.drop("bytes")


def referenced(manifest_parts: DataFrame) -> DataFrame:
    """Distinct digests that manifests refer to; digests that aren't 64 hex digits are left to ``doctor``."""
    return manifest_parts.where(F.col("sha256").rlike("^[0-9a-f]{64}$")).select("sha256").distinct()


def orphans(objects: DataFrame, manifest_parts: DataFrame, invalid_manifests: int = 0) -> DataFrame:
    """Objects that no manifest refers to; refuses to say while any manifest is invalid."""
    if invalid_manifests:
        raise ValueError(f"{invalid_manifests} manifests are invalid: orphans can't be told")
    return objects.join(referenced(manifest_parts), "sha256", "left_anti")


def doctor(manifest_parts: DataFrame, objects: DataFrame) -> DataFrame:
    """Issue rows (session_id, part_idx, issue) of manifests against stored objects; a bad one is an issue, not an abort."""
    o = objects.select("sha256", F.col("raw_bytes").alias("stored_raw"), (F.sha2("bytes", 256) == F.col("sha256")).alias("intact"))
    p = manifest_parts.join(o, "sha256", "left")
    issue = (
        F.when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "invalid_digest").when(~F.col("kind").isin("residual", "field", "record"), "invalid_kind")
        .when(F.col("stored_raw").isNull(), "missing_object").when(F.col("stored_raw") != F.col("raw_bytes"), "size_mismatch").when(~F.col("intact"), "damaged_object")
    )
    return p.select("session_id", "part_idx", issue.alias("issue")).where("issue IS NOT NULL")


def storage_estimate(raw: Column) -> Column:
    """What folding may need: the raw bytes, a sixteenth, and a MiB."""
    return raw + F.floor(raw / 16).cast("long") + F.lit(1 << 20)


def first_available(wanted: DataFrame, loose: DataFrame, packed: DataFrame) -> DataFrame:
    """(sha256, bytes): an object from the loose store, else from packs."""
    found = wanted.select("sha256").distinct().join(loose.select("sha256", F.col("bytes").alias("l")), "sha256", "left").join(packed.select("sha256", F.col("bytes").alias("p")), "sha256", "left")
    return found.select("sha256", F.coalesce("l", "p").alias("bytes"))
