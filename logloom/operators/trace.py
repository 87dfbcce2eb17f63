"""Filesystem traces as contracts of operations, and contracts against what is known."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operations that traces may name, kernel names of some, and the shape of signatures.
OPERATIONS = (
    "open openat close release read pread readv write pwrite writev flush fsync fdatasync stat stat64 lstat lstat64 fstat fstat64 statfs getattr readdir access chmod chown utimens mmap truncate "
    "ftruncate create mknod mkdir rmdir link symlink readlink rename renameat unlink unlinkat flock fcntl clonefile getattrlist setxattr getxattr listxattr removexattr"
).split()
KERNEL_NAMES = {"getdirentries64": "readdir", "statfs64": "statfs", "fstatfs64": "statfs", "fstatat64": "fstat", "open_dprotected": "open"}
SIGNATURE = r"\([A-Z_]{4,32}\)|<[A-Z0-9_=+-]+>"
ANY_OPERATION = r"(?i)\b(" + "|".join(OPERATIONS) + r")\b"


def operation(line: Column) -> Column:
    """The operation that a trace line names, lower-cased; '' for none.

    The second token decides if it is operation=… or a kernel name, io=… lines count for none; else the first name in the line.
    """
    token = F.lower(F.get(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), F.lit(1)))
    named = F.regexp_replace(token, "^operation=", "")
    out = F.when(token.startswith("operation="), F.when(named == "sync", "fsync").when(named.isin(*OPERATIONS), named).otherwise(""))
    out = out.when(token.startswith("io="), "").when(token.rlike(r"^rddata(\[|$)"), "read").when(token.rlike(r"^wrdata(\[|$)"), "write")
    for kernel, name in KERNEL_NAMES.items():
        out = out.when(token == kernel, name)
    return out.otherwise(F.lower(F.regexp_extract(line, ANY_OPERATION, 1)))


def contract(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(name, count, first_line) of the operations, to be read in the order of their first line."""
    named = lines.select(F.col(order).alias("line_no"), operation(F.col(line)).alias("name")).where("name <> ''")
    return named.groupBy("name").agg(F.count("*").alias("count"), F.min("line_no").alias("first_line"))


def signatures(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, signature, count) of all signatures in lines that name an operation."""
    named = lines.select(operation(F.col(line)).alias("name"), F.explode(F.regexp_extract_all(line, F.lit(SIGNATURE), F.lit(0))).alias("signature")).where("name <> ''")
    return named.groupBy("name", "signature").agg(F.count("*").alias("count"))


def trace_digest(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(trace_sha256) of all lines, each with a newline: one digest of one trace file, so its lines stream through one task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for batch in batches:
            for x in batch["line"].to_pylist():
                h.update((x or "").encode() + b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["trace_sha256"])

    one = lines.select(F.col(order).alias("line_no"), F.col(line).alias("line"))
    return one.repartition(1).sortWithinPartitions("line_no", "line").mapInArrow(digest, "trace_sha256 string")


def unknown_clients(observed: DataFrame, contracts: DataFrame) -> DataFrame:
    """Observed (platform, kind, version) without a contract; a blank kind or version never has one."""
    key = ["platform", "kind", "version"]
    blank = (F.trim("kind") == "") | (F.trim("version") == "")
    return observed.where(F.coalesce(blank, F.lit(True))).unionByName(observed.where(~F.coalesce(blank, F.lit(True))).join(contracts.select(*key), key, "left_anti"))


def evaluation(observed: DataFrame, contracts: DataFrame) -> DataFrame:
    """(unknown, verdict): any unknown client quarantines."""
    return unknown_clients(observed, contracts).agg(F.count("*").alias("unknown")).withColumn("verdict", F.when(F.col("unknown") > 0, "quarantine").otherwise("allow"))


def open_files(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(pid, file, path, writer) from field-prefixed lines p, f, a and n of one listing.

    A record is what follows a p or f line up to the next; it writes if its access has w or u.
    """
    from pyspark.sql import Window as W

    w = W.orderBy(order)  # one listing is one process' output
    tag, value = F.substring(line, 1, 1), F.substring(line, 2, 1 << 20)
    x = lines.select(F.col(order).alias("at"), tag.alias("tag"), value.alias("value")).withColumnRenamed("at", order)
    x = x.withColumn("rec", F.sum(F.col("tag").isin("p", "f").cast("int")).over(w)).withColumn("pid", F.last(F.when(F.col("tag") == "p", F.col("value")), True).over(w))
    pick = lambda t: F.max(F.when(F.col("tag") == t, F.col("value")))
    g = x.groupBy("rec", "pid").agg(pick("f").alias("file"), pick("a").alias("access"), pick("n").alias("path"))
    path = F.regexp_replace("path", r" \(deleted\)$", "")
    return g.where("file IS NOT NULL AND path IS NOT NULL").select("pid", "file", path.alias("path"), F.coalesce(F.col("access").rlike("[wu]"), F.lit(False)).alias("writer"))
