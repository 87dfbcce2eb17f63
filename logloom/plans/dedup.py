"""Queries over the duplicate layers, session selection and record relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import dedup, select
from logloom.plans.registry import query
from logloom.sources.tables import catalog, conversation_records, document_records

#: Records of documents: a line with its newline, the last without; the CTE every SQL below starts with.
RECORDS = """
pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents),
records AS (SELECT doc_id AS session_id, i AS rec_idx, CASE WHEN i < n - 1 THEN piece || chr(10) ELSE piece END AS record FROM pieces WHERE NOT (i = n - 1 AND piece = ''))
"""
OBJECTS = RECORDS + ", objects AS (SELECT sha256(record) AS digest, strlen(record)::BIGINT AS size, count(*)::BIGINT AS occurrences FROM records GROUP BY ALL)\n"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.observations(dedup.record_layer(document_records(spark, sf_dir)))


@query(f"""WITH {OBJECTS} SELECT 'record' AS layer, sum(occurrences)::BIGINT AS object_count, count(*) AS unique_objects, sum(size * occurrences)::BIGINT AS total_bytes,
    sum(size)::BIGINT AS unique_bytes, sum(occurrences - 1)::BIGINT AS duplicate_occurrences, sum(size * (occurrences - 1))::BIGINT AS duplicate_bytes FROM objects""")
def record_layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.layer_stats(_observed(spark, sf_dir))


@query(f"""WITH {OBJECTS} SELECT digest, size, occurrences, size * (occurrences - 1) AS duplicate_bytes FROM objects WHERE occurrences > 1
    ORDER BY duplicate_bytes DESC, size DESC, digest LIMIT 20""")
def record_top_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.top_objects(_observed(spark, sf_dir), 20).select("digest", "size", "occurrences", "duplicate_bytes")


@query(f"WITH {OBJECTS} SELECT digest, size, occurrences FROM objects WHERE occurrences > 1")
def duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_records(_observed(spark, sf_dir))


@query(f"WITH {OBJECTS} SELECT session_id, rec_idx FROM records JOIN objects ON sha256(record) = digest AND strlen(record) = size WHERE occurrences > 1")
def duplicate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.is_duplicate(document_records(spark, sf_dir), dedup.duplicate_records(_observed(spark, sf_dir))).select("session_id", "rec_idx")


@query(f"WITH {OBJECTS} SELECT count(DISTINCT digest) AS digests FROM objects")
def exact_distinct_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir).agg(F.countDistinct("digest").alias("digests"))


@query(f"""WITH {RECORDS}, s AS (SELECT session_id, count(*) AS records, sum(strlen(record))::BIGINT AS scanned_bytes FROM records GROUP BY session_id)
    SELECT count(*) AS sessions, coalesce(sum(records), 0)::BIGINT AS records, coalesce(sum(scanned_bytes), 0)::BIGINT AS scanned_bytes, max(scanned_bytes) AS largest FROM s""")
def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dedup.counters(document_records(spark, sf_dir), 0, 1 << 25)
    return c.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("scanned_bytes"), F.lit(0)).alias("scanned_bytes"), F.max("scanned_bytes").alias("largest"))


@query(f"""WITH {OBJECTS} SELECT round(sum(size * (occurrences - 1))::DOUBLE / sum(size * occurrences)::DOUBLE * 100, 6) AS duplicate_percent FROM objects""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = dedup.layer_stats(_observed(spark, sf_dir))
    return stats.select(F.round(dedup.share_percent(F.col("duplicate_bytes"), F.col("total_bytes")), 6).alias("duplicate_percent"))


CATALOG = """c AS (SELECT doc_id::VARCHAR AS id, source AS title, lang AS cwd, doc_id AS updated_at, doc_id % 3 = 0 AS archived, coalesce(strlen(text), 0)::BIGINT AS size FROM documents)"""


@query(f"WITH {CATALOG} SELECT id, title, cwd, size FROM c WHERE NOT archived AND (contains(lower(id), 'src1') OR contains(lower(title), 'src1') OR contains(lower(cwd), 'src1'))")
def select_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.search(select.unarchived(catalog(spark, sf_dir)), " SRC1 ").select("id", "title", "cwd", "size")


@query(f"""WITH {CATALOG}, g AS (SELECT title, list(struct_pack(negative := -size, id := id) ORDER BY -size, id) AS s FROM c WHERE size <= 20000 GROUP BY title),
    f AS (SELECT title, list_reduce(list_transform(s, lambda x: struct_pack(used := -x.negative, ids := [x.id])), lambda a, x: CASE WHEN a.used + x.used <= 20000 THEN struct_pack(used := a.used + x.used, ids := list_concat(a.ids, x.ids)) ELSE a END).ids AS ids FROM g)
    SELECT title, unnest(ids) AS id FROM f""")
def select_greedy_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.greedy_within(catalog(spark, sf_dir), 20_000, "title").select("title", "id")


@query(f"WITH {CATALOG} SELECT id, size FROM c WHERE NOT archived ORDER BY size DESC, id LIMIT 25")
def select_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.largest_first(select.unarchived(catalog(spark, sf_dir))).limit(25).select("id", "size")


@query(f"""WITH {CATALOG} SELECT count(*) - count(d.doc_id) AS missing, count(d.doc_id) AS found FROM c LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0) d ON c.id = d.doc_id::VARCHAR""")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return select.missing_files(c, c.where("updated_at % 10 <> 0").select(F.col("rollout_path").alias("path"), "size"))
