"""Queries over record sequences, the spawn graph, and branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import graph, reconcile, sequence
from logloom.plans.dedup import RECORDS
from logloom.plans.registry import query
from logloom.sources.tables import conversation_records, document_records, spawn_edges, table

#: Pairs of neighbouring documents.
PAIRS = """pairs AS (SELECT doc_id AS left_id, doc_id + 1 AS right_id FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)
    UNION ALL SELECT doc_id, doc_id + 50 FROM documents WHERE doc_id + 50 IN (SELECT doc_id FROM documents))"""
NUMBERED = RECORDS + f", {PAIRS}"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    both = [ids.select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + step).alias("right_id")) for step in (1, 50)]
    return both[0].unionByName(both[1]).join(ids.select(F.col("doc_id").alias("right_id")), "right_id", "left_semi").select("left_id", "right_id")


SHARED = """counts AS (SELECT session_id, record, count(*) AS n FROM records GROUP BY ALL),
    shared AS (SELECT left_id, right_id, sum(least(l.n, r.n))::BIGINT AS shared FROM pairs JOIN counts l ON l.session_id = left_id JOIN counts r ON r.session_id = right_id AND l.record = r.record GROUP BY ALL)"""
PREFIX = """sizes AS (SELECT session_id, count(*) AS n FROM records GROUP BY ALL),
    met AS (SELECT left_id, right_id, min(CASE WHEN l.record <> r.record THEN l.rec_idx END) AS bad, min(least(x.n, y.n)) AS most FROM pairs JOIN records l ON l.session_id = left_id JOIN records r ON r.session_id = right_id AND l.rec_idx = r.rec_idx
        JOIN sizes x ON x.session_id = left_id JOIN sizes y ON y.session_id = right_id GROUP BY ALL)"""
HELD = """texts AS (SELECT session_id, count(*) AS n, list(sha256(record) ORDER BY rec_idx) AS hs FROM records GROUP BY ALL),
    spots AS (SELECT l.session_id AS needle_id, r.session_id AS container_id, l.n AS records, unnest(range(r.n - l.n + 1)) AS place, l.hs AS lh, r.hs AS rh FROM texts l JOIN texts r ON l.session_id <> r.session_id AND l.n <= r.n AND list_contains(r.hs, l.hs[1])),
    held AS (SELECT needle_id, container_id, records, min(place)::BIGINT AS place FROM spots WHERE rh[place + 1] = lh[1] AND rh[place + 1 : place + records] = lh GROUP BY ALL)"""


@query(f"WITH {NUMBERED}, {SHARED} SELECT left_id, right_id, coalesce(shared, 0)::BIGINT AS shared FROM pairs LEFT JOIN shared USING (left_id, right_id)")
def shared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.shared_records(_pairs(spark, sf_dir), document_records(spark, sf_dir))


@query(f"WITH {NUMBERED}, {PREFIX} SELECT left_id, right_id, coalesce(bad, most, 0)::BIGINT AS prefix FROM pairs LEFT JOIN met USING (left_id, right_id)")
def shared_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.shared_prefix(_pairs(spark, sf_dir), document_records(spark, sf_dir))


@query(f'WITH {NUMBERED}, {HELD} SELECT needle_id, container_id, records, place AS "at" FROM held')
def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.containment(document_records(spark, sf_dir))


@query(f"""WITH {NUMBERED}, {SHARED}, {PREFIX}, {HELD}, f AS (
    SELECT p.left_id, p.right_id, coalesce(bad, most, 0)::BIGINT AS prefix, coalesce(shared, 0)::BIGINT AS shared, l.needle_id IS NOT NULL AS l, r.needle_id IS NOT NULL AS r
    FROM pairs p LEFT JOIN met USING (left_id, right_id) LEFT JOIN shared USING (left_id, right_id)
    LEFT JOIN held l ON l.needle_id = p.left_id AND l.container_id = p.right_id LEFT JOIN held r ON r.needle_id = p.right_id AND r.container_id = p.left_id)
    SELECT left_id, right_id, prefix, shared, CASE WHEN l AND r THEN 'identical' WHEN l THEN 'left_contained' WHEN r THEN 'right_contained' WHEN prefix > 0 THEN 'independent_tails' WHEN shared > 0 THEN 'shared_records' ELSE 'unknown' END AS relation,
        l OR r OR prefix > 0 OR shared > 0 AS verified_exact FROM f""")
def pair_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session begins with a meta record of its own, which must not count."""
    r = document_records(spark, sf_dir)
    meta = r.select("session_id").distinct().select("session_id", F.lit(0).cast("long").alias("rec_idx"), F.concat(F.lit('{"type":"session_meta","payload":{"id":'), F.col("session_id").cast("string"), F.lit("}}\n")).alias("record"))
    return sequence.pair_relation(_pairs(spark, sf_dir), meta.unionByName(r.withColumn("rec_idx", F.col("rec_idx") + 1)))


@query(f"""WITH {RECORDS} SELECT session_id, rec_idx, sum(strlen(record)) OVER (PARTITION BY session_id ORDER BY rec_idx)::BIGINT AS "end", (sum(strlen(record)) OVER (PARTITION BY session_id ORDER BY rec_idx) - strlen(record))::BIGINT AS start FROM records""")
def record_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.offsets(document_records(spark, sf_dir)).select("session_id", "rec_idx", "start", "end")


EDGES = "e AS (SELECT DISTINCT conv_id // 2 AS parent_id, conv_id AS child_id FROM conversations WHERE conv_id > 0 AND conv_id % 7 <> 3), ids AS (SELECT DISTINCT conv_id AS id FROM conversations)"
SEED = 5
UP = f"up AS (SELECT {SEED}::BIGINT AS node UNION SELECT parent_id FROM up JOIN e ON child_id = node)"
DOWN = f"down AS (SELECT {SEED}::BIGINT AS node UNION SELECT child_id FROM down JOIN e ON parent_id = node)"
AROUND = f"b AS (SELECT parent_id AS s, child_id AS d FROM e UNION SELECT child_id, parent_id FROM e), around AS (SELECT {SEED}::BIGINT AS node UNION SELECT d FROM around JOIN b ON s = node)"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).where("id IS NOT NULL").distinct()


@query(f"WITH RECURSIVE {EDGES}, {AROUND} SELECT node, node IN (SELECT id FROM ids) AS in_catalog FROM around")
def family_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.family(spawn_edges(spark, sf_dir), _ids(spark, sf_dir), SEED)


@query(f"""WITH RECURSIVE {EDGES}, {AROUND}, {UP}, {DOWN} SELECT id AS node, CASE WHEN id = {SEED} THEN 'seed' WHEN id IN (SELECT node FROM up) THEN 'ancestor' WHEN id IN (SELECT node FROM down) THEN 'descendant'
    WHEN id IN (SELECT node FROM around) THEN 'collateral' ELSE 'none' END AS relation FROM ids""")
def graph_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relation(spawn_edges(spark, sf_dir), _ids(spark, sf_dir), SEED)


BRANCHES = """ev AS (SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) * 1000 AS epoch_ns, sha256(event_type || '|' || coalesce(props, '')) AS digest, strlen(event_type || '|' || coalesce(props, ''))::BIGINT AS size, event_id FROM events WHERE user_id IS NOT NULL),
    base AS (SELECT * FROM ev WHERE event_id % 3 <> 0), branch AS (SELECT * FROM ev WHERE event_id % 2 = 0 OR event_id % 3 = 0),
    added AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY session_id, digest, size ORDER BY seq) AS copy FROM branch b) x LEFT JOIN (SELECT session_id, digest, size, count(*) AS have FROM base GROUP BY ALL) h USING (session_id, digest, size) WHERE copy > coalesce(have, 0))"""


def _branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    text = F.concat("event_type", F.lit("|"), F.coalesce("props", F.lit("")))
    ev = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    ev = ev.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("epoch_ns"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("size"), "event_id"
    )
    return ev.where("event_id % 3 <> 0").drop("event_id"), ev.where("event_id % 2 = 0 OR event_id % 3 = 0").drop("event_id")


@query(f"""WITH {BRANCHES}, b AS (SELECT session_id, count(*) AS nb FROM base GROUP BY ALL), r AS (SELECT session_id, count(*) AS nr FROM branch GROUP BY ALL), a AS (SELECT session_id, count(*) AS na FROM added GROUP BY ALL)
    SELECT session_id, coalesce(nr, 0) - coalesce(na, 0) AS shared, coalesce(nb, 0) - coalesce(nr, 0) + coalesce(na, 0) AS base_only, coalesce(na, 0) AS added, coalesce(nb, 0) + coalesce(na, 0) AS output FROM b FULL JOIN r USING (session_id) LEFT JOIN a USING (session_id)""")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.analyze(*_branches(spark, sf_dir))


@query(f"""WITH {BRANCHES}, u AS (SELECT session_id, seq, epoch_ns, 0 AS origin FROM base UNION ALL SELECT session_id, seq, epoch_ns, 1 FROM added)
    SELECT session_id, seq, origin, row_number() OVER (PARTITION BY session_id ORDER BY epoch_ns, origin, seq) - 1 AS ord FROM u""")
def reconcile_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.merge(*_branches(spark, sf_dir)).select("session_id", "seq", "origin", "ord")


@query("""WITH e AS (SELECT user_id AS session_id, epoch_us(ts) * 1000 AS epoch_ns, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS seq FROM events WHERE user_id IS NOT NULL),
    l AS (SELECT *, lag(epoch_ns) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM e)
    SELECT session_id, count(*) AS records, count(*) FILTER (WHERE epoch_ns < before) AS regressions, min_by(epoch_ns, seq) AS first_ns, max_by(epoch_ns, seq) AS last_ns FROM l GROUP BY session_id""")
def timestamp_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("value", "event_id"))
    return reconcile.regressions(e.select(F.col("user_id").alias("session_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("epoch_ns"), seq.alias("seq")))


@query("""SELECT CASE WHEN role IN ('user', 'assistant') THEN 'response_item:' || role ELSE '' END AS kind, count(*) AS records FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1""")
def conversation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_records(spark, sf_dir).groupBy(reconcile.conversation_kind(F.col("record")).alias("kind")).agg(F.count("*").alias("records"))


@query(f"""WITH {RECORDS}, d AS (SELECT session_id, list(sha256(record) ORDER BY rec_idx) AS ds FROM records GROUP BY session_id)
    SELECT session_id, list_reduce(list_concat([repeat('0', 64)], ds), lambda h, x: sha256(unhex(h || x))) AS chain FROM d""")
def conversation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.chains(document_records(spark, sf_dir))
