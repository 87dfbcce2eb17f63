"""What a store keeps beside its objects: manifests, journals, observations, contracts, and the current pointer.

Schemas are fixed; nothing is inferred. Missing folders are empty tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.select import SAFE_ID

MANIFEST = "version int, kind string, created_at string, session struct<id:string>, source struct<bytes:long,sha256:string>, parts array<struct<kind:string,json_path:string,sha256:string,raw_bytes:long,stored_bytes:long>>"
OBSERVATION = "session_id string, path string, size long, mtime long, stable_since long"
CONTRACT = "platform string, kind string, version string, operations array<struct<name:string,count:long>>"
JOURNAL = "seq long, operation string, phase string, session_id string"
#: Versions of manifests with the part kinds that each may have.
PART_KINDS = {1: ("residual", "field"), 2: ("residual", "field", "record")}


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def load_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, issue, …manifest) of all .json files below ``path``; ``issue`` is null for valid ones."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"path string, issue string, {MANIFEST}")
    r = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    r = r.withColumn("path", F.col("_metadata.file_path"))
    known = F.lit(False)
    for version, kinds in PART_KINDS.items():
        known = known | ((F.col("version") == version) & (F.size(F.array_except(F.col("parts.kind"), F.array(*map(F.lit, kinds)))) == 0))
    digests = F.forall("parts", lambda p: F.coalesce(p["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)))
    issue = (
        F.when(F.col("version").isNull() | F.col("parts").isNull(), "unreadable").when(~F.col("version").isin(*PART_KINDS), "unknown_version")
        .when(~F.coalesce(known, F.lit(False)), "unknown_part_kind").when(~digests, "invalid_digest")
    )
    return r.select("path", issue.alias("issue"), "version", "kind", "created_at", "session", "source", "parts")


def manifest_parts(manifests: DataFrame) -> DataFrame:
    """(session_id, part_idx, kind, json_path, sha256, raw_bytes, stored_bytes) of the valid manifests' parts."""
    valid = manifests.where("issue IS NULL").select(F.col("session.id").alias("session_id"), F.posexplode("parts").alias("part_idx", "p"))
    return valid.select("session_id", F.col("part_idx").cast("long").alias("part_idx"), "p.*")


def commit_manifests(parts: DataFrame, path: str, created_at: str, version: int = 1) -> None:
    """One manifest per session from its ``parts``, at a path that must not exist yet."""
    part = F.struct("part_idx", F.struct("kind", "json_path", "sha256", "raw_bytes", "stored_bytes").alias("p"))
    m = parts.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["p"]).alias("parts"), F.sum("raw_bytes").alias("n"))
    m = m.select(F.lit(version).alias("version"), F.lit("manifest").alias("kind"), F.lit(created_at).alias("created_at"), F.struct(F.col("session_id").cast("string").alias("id")).alias("session"), F.struct(F.col("n").alias("bytes")).alias("source"), "parts")
    m.write.mode("errorifexists").json(path)


def load_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal entries in their order; a line that isn't an entry is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], JOURNAL)
    return spark.read.schema(JOURNAL).option("mode", "FAILFAST").json(path).orderBy("seq")


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATION).parquet(path) if exists(spark, path) else spark.createDataFrame([], OBSERVATION)


def save_observations(observations: DataFrame, path: str) -> None:
    """Replace the observations by a new folder that takes the old one's place once it is whole."""
    spark = observations.sparkSession
    observations.select("session_id", "path", "size", "mtime", "stable_since").write.mode("overwrite").parquet(f"{path}.new")
    fs, target = _file_system(spark, path)
    fs.delete(target, True)
    if not fs.rename(_file_system(spark, f"{path}.new")[1], target):
        raise OSError(f"{path} could not be replaced")


def load_contracts(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], CONTRACT)
    return spark.read.schema(CONTRACT).option("recursiveFileLookup", True).json(path).orderBy("platform", "kind", "version")


def save_contract(spark: SparkSession, path: str, platform: str, kind: str, version: str, operations: DataFrame) -> str:
    """Write a contract of (name, count) operations as one JSON line below ``path``; returns its folder.

    Its name is made of the three parts, in which all but letters, digits, dots and dashes become dashes; a part that is
    blank or only dots is an error.
    """
    parts = [re.sub(r"[^A-Za-z0-9.-]+", "-", x.strip()) for x in (platform, kind, version)]
    if not all(x.strip(".-") for x in parts):
        raise ValueError("a contract needs a platform, a kind and a version")
    target = f"{path}/{'_'.join(parts)}"
    listed = operations.agg(F.sort_array(F.collect_list(F.struct("name", "count"))).alias("operations"))  # one row per operation name
    row = listed.select(F.lit(platform).alias("platform"), F.lit(kind).alias("kind"), F.lit(version).alias("version"), "operations")
    row.coalesce(1).write.mode("overwrite").json(target)
    return target


AUDIT = "at long, sha256 string, raw_bytes long, generation string"


def audit_retirement(retired: DataFrame, path: str, generation: str, at: int) -> None:
    """Append the loose objects (sha256, raw_bytes) that a pack generation retires to the audit table, once per generation."""
    rows = retired.select(F.lit(at).cast("long").alias("at"), "sha256", F.col("raw_bytes").cast("long").alias("raw_bytes"), F.lit(generation).alias("generation"))
    rows.write.mode("overwrite").parquet(f"{path}/of={generation}")


def load_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).parquet(path).select(*[c.split()[0] for c in AUDIT.split(", ")]) if exists(spark, path) else spark.createDataFrame([], AUDIT)


STATE = "session_id string, generation long, base_bytes long, delta_bytes long, backing_bytes long"


def session_states(spark: SparkSession, root: str) -> DataFrame:
    """The states that state.json files below ``root`` give, in the order of session ids; an invalid one is an error.

    A state needs an id that is a plain name and equals its folder's, a generation of 1 or more, and no negative size.
    """
    if not exists(spark, root):
        return spark.createDataFrame([], STATE)
    found = spark.read.schema(STATE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "state.json").json(root)
    found = found.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/state\.json$", 1))
    sizes = [F.coalesce(F.col(c), F.lit(0)) >= 0 for c in ("base_bytes", "delta_bytes", "backing_bytes")]
    sound = F.col("session_id").rlike(SAFE_ID) & (F.col("session_id") == F.url_decode("folder")) & (F.col("generation") >= 1) & sizes[0] & sizes[1] & sizes[2]
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("session_id")).otherwise(F.raise_error(F.concat(F.lit("invalid state in "), F.col("folder"))).cast("string"))
    return found.withColumn("session_id", checked).drop("folder").orderBy("session_id")


def object_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime) of the loose .zst objects below ``path``; their bytes aren't read."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, size long, mtime timestamp")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zst").load(path)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def publish(spark: SparkSession, root: str, generation: str) -> None:
    """Make a verified generation current: its name is written beside the pointer and renamed over it."""
    fs, pointer = _file_system(spark, f"{root}/CURRENT")
    _, fresh = _file_system(spark, f"{root}/.CURRENT-{generation}")
    out = fs.create(fresh, True)
    try:
        out.writeBytes(generation)
    finally:
        out.close()
    fs.delete(pointer, False)
    if not fs.rename(fresh, pointer):
        raise OSError(f"{generation} could not be made current")


def current(spark: SparkSession, root: str) -> str | None:
    rows = spark.read.text(f"{root}/CURRENT").collect() if exists(spark, f"{root}/CURRENT") else []
    return rows[0]["value"] if rows else None
