"""WARC records in a content-addressed archive.

An archive is a folder of two Parquet tables. ``payloads`` has each distinct payload once, under its SHA-256
digest, which readers verify. ``records`` has the exact header of every record. A record's bytes come back
by joining its header with the payload of its digest. Of the records that share a large payload, the first
by id is the response; the others are revisits that refer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.staging import scratch, stage

MIN_REVISIT_BYTES = 100

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEWLINE = "\r\n"


def _header(fields: list[tuple[str, Column]]) -> Column:
    """Header lines in order; a field whose value is null is left out. Ends with the empty line."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(NEWLINE)) for name, value in fields]
    return F.concat(F.lit(VERSION + NEWLINE), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(NEWLINE))


def header_field(header: Column, name: str) -> Column:
    """A field's value as it stands in a header; null where the header lacks it."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


#: A target URI with line ends can't stand in a header as it is; this field says that it is percent-encoded.
ENCODED = "X-Target-URI-Encoding"


def _broken(url: Column) -> Column:
    return F.coalesce(url.contains("\r") | url.contains("\n"), F.lit(False))


def _one_line(url: Column) -> Column:
    """Line ends percent-encoded, and percent signs too then; other URIs stay as they are."""
    encoded = F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(_broken(url), encoded).otherwise(url)


def _unfolded(uri: Column, encoding: Column) -> Column:
    plain = F.replace(F.replace(F.replace(uri, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    return F.when(encoding == "percent", plain).otherwise(uri)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one record per row to the archive at ``path`` (which must not exist).

    The payload is the column's UTF-8 text or bytes; null is empty. Records with equal payloads of at least
    ``min_revisit_bytes`` become one response (the smallest id) and revisits; smaller ones are all responses.
    A null url leaves out the target URI. Rows that share an id are records of their own: the first of a payload is its
    response, the others revisit that id. A null id comes after all others and is written empty, also where revisits
    refer to it. Other columns are not read. An empty table gives an archive without records.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    # payloads once each: partial aggregation drops copies before the shuffle
    hashed = rows.withColumn("digest", F.sha2("payload", 256))
    hashed.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    with scratch(pages.sparkSession):
        _write_headers(hashed, path, date, min_revisit_bytes)


def _write_headers(hashed: DataFrame, path: str, date: str, min_revisit_bytes: int) -> None:
    facts = hashed.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    facts = stage(facts, "warc-facts")  # so that all readings agree on the rows' numbers, and pages are read no third time
    place = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row")
    firsts = facts.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    shared = firsts.where("copies > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    records = facts.join(shared, "digest", "left")
    revisit = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))

    def record_id(key: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))

    header = _header([
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", record_id(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _one_line(F.col("url"))),
        (ENCODED, F.when(_broken(F.col("url")), F.lit("percent"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("first_id")))),
        ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
    ])
    records.select("page_id", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """What each record's header says: record_id, header, record_type, digest, refers_to, target_uri."""
    records = spark.read.schema("page_id long, header string").parquet(f"{path}/records").select("header")
    key = r"<urn:page:([^>]*)>"
    return records.select(
        "header",
        F.regexp_extract(header_field(F.col("header"), "WARC-Record-ID"), key, 1).alias("record_id"),
        header_field(F.col("header"), "WARC-Type").alias("record_type"),
        F.replace(header_field(F.col("header"), "WARC-Payload-Digest"), F.lit("sha256:"), F.lit("")).alias("digest"),
        F.regexp_extract(header_field(F.col("header"), "WARC-Refers-To"), key, 1).alias("refers_to"),
        _unfolded(header_field(F.col("header"), "WARC-Target-URI"), F.coalesce(header_field(F.col("header"), ENCODED), F.lit(""))).alias("target_uri"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads with their verified digest and size; fails on one that doesn't match its digest."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    actual = F.sha2("payload", 256)
    verified = F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("digest"))))
    return stored.select(verified.alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record: its header's fields with the verified size of its payload. No payload is moved."""
    return read_headers(spark, path).join(read_payloads(spark, path).drop("payload"), "digest")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Every record's own bytes (``record``) and full ``payload``; a revisit's payload is that of its response."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "digest")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header").cast("binary"), block, F.lit((NEWLINE * 2).encode()))
    return joined.select("record_id", "record_type", "refers_to", "target_uri", "digest", "payload_bytes", "payload", record.alias("record"))
