"""What leaves the engine: sessions as JSONL files, repairs with their orphans, and packs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators import pack
from logloom.sources.shared import scratch, stage

ZSTD_LEVEL = 3


def write_sessions(records: DataFrame, path: str, order: str = "rec_idx") -> None:
    """One folder per session with one file of its records in order, each ended by one newline; ``path`` must not exist.

    Sessions are dealt by id, so each is sorted and written by one task, record after record.
    """
    line = F.rtrim(F.col("record").cast("string"), F.lit("\r\n"))
    rows = records.select("session_id", order, line.alias("value")).repartition("session_id").sortWithinPartitions("session_id", order)
    rows.select("session_id", "value").write.partitionBy("session_id").text(path)


def write_repaired(repaired: DataFrame, path: str) -> None:
    """``repair.repaired`` as two folders, ``records`` and ``orphans``, and a table of the sessions that failed, ``errors``."""
    with scratch(repaired.sparkSession):
        found = stage(repaired, "repaired")
        for kind, folder in (("record", "records"), ("orphan", "orphans")):
            write_sessions(found.where(F.col("kind") == kind), f"{path}/{folder}", "idx")
        found.where("kind = 'error'").select("session_id", F.col("record").cast("string").alias("error")).write.parquet(f"{path}/errors")


@F.pandas_udf(T.BinaryType())
def _compressed(blocks: pd.Series) -> pd.Series:
    import zstandard

    compressor = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
    return blocks.map(lambda b: compressor.compress(bytes(b)))


@F.pandas_udf(T.BinaryType())
def _decompressed(blocks: pd.Series) -> pd.Series:
    import zstandard

    decompressor = zstandard.ZstdDecompressor()
    return blocks.map(lambda b: None if b is None else decompressor.decompress(bytes(b)))


def write_packs(objects: DataFrame, path: str, block_bytes: int = pack.BLOCK_BYTES, limit: int = pack.PACK_BYTES, shard_digits: int = 2) -> None:
    """Objects (sha256, bytes) as a pack generation at ``path``: ``packs`` with the encoded blocks, and their ``index``.

    Each block is stored raw or as zstd, whichever ``pack.encoding`` chooses. Packs are numbered within shards, the first
    ``shard_digits`` of the digest, so that they are filled side by side. The index has all but the bytes.
    """
    spark = objects.sparkSession
    with scratch(spark):
        b = pack.blocks(objects, block_bytes).withColumn("zstd", _compressed("bytes"))
        b = b.withColumn("encoding", pack.encoding(F.octet_length("bytes"), F.octet_length("zstd")))
        b = b.withColumn("bytes", F.when(F.col("encoding") == "raw", F.col("bytes")).otherwise(F.col("zstd"))).drop("zstd")
        b = stage(b.withColumns({"stored_bytes": F.octet_length("bytes").cast("long"), "shard": F.substring("sha256", 1, shard_digits)}), "blocks")
        places = pack.rotate(b.select("shard", "sha256", "block_idx", "stored_bytes"), limit, "shard").drop("stored_bytes")
        placed = b.join(places, ["shard", "sha256", "block_idx"])
        placed.repartition("shard", "pack").sortWithinPartitions("shard", "pack", "pack_offset").write.partitionBy("shard", "pack").parquet(f"{path}/packs")
        _packs(spark, path).drop("bytes").write.parquet(f"{path}/index")


PACKED = "sha256 string, block_idx long, raw_offset long, raw_bytes long, block_sha256 string, bytes binary, encoding string, stored_bytes long, pack_offset long, shard string, pack long"


def _packs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKED).parquet(f"{path}/packs")


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a pack generation, decoded: (sha256, block_idx, raw_offset, raw_bytes, block_sha256, bytes)."""
    raw = F.col("encoding") == "raw"
    plain = F.when(raw, F.col("bytes")).otherwise(_decompressed(F.when(~raw, F.col("bytes"))))
    return _packs(spark, path).select("sha256", "block_idx", "raw_offset", "raw_bytes", "block_sha256", plain.alias("bytes"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of a pack generation: where each block lies, without reading any."""
    return spark.read.schema(PACKED).parquet(f"{path}/index").drop("bytes")
