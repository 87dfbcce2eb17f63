"""Intermediate tables in the folder that all executors and the driver share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_scopes = threading.local()  # what ``collecting`` has open in this thread: lists of paths, the innermost last


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/logloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage the way a reliable checkpoint does, but as Parquet, so later readers prune columns
    and a lost executor costs a re-read instead of a recomputation. With ``keep`` the table outlives the innermost
    ``collecting``, as the result that is handed on, and belongs to the next one out.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    scopes = getattr(_scopes, "open", [])
    scopes = scopes[:-1] if keep else scopes
    if scopes:
        scopes[-1].append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder; those gone already don't matter."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def collecting() -> Iterator[list[str]]:
    """Collect the paths of the tables that are staged inside."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield _scopes.open[-1]
    finally:
        _scopes.open = _scopes.open[:-1]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are deleted at the end, but those staged with ``keep``."""
    with collecting() as paths:
        try:
            yield
        finally:
            delete(spark, paths)
