"""Queries over fields, chunks, folds, packs, the store, enrollment, traces and incremental scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as text_functions
from logloom.functions.cdc import Bounds
from logloom.operators import dedup, enroll, fold, layers, pack, preflight, store, trace
from logloom.plans.chunks import CONVERSATION, ESCAPED, cdc
from logloom.plans.dedup import OBJECTS, RECORDS
from logloom.plans.registry import query
from logloom.sources.shared import stage
from logloom.sources.tables import conversation_records, document_records, page_records, table
from logloom.streaming import appends, incremental

FIELD_BYTES, PAGE_FIELD_BYTES = 64, 4096
BOUNDS = Bounds(64, 256, 1024)
SETTINGS = fold.FoldSettings(FIELD_BYTES, BOUNDS)

#: String tokens of conversation records that are long enough, with their paths.
TOKENS = """t AS (SELECT conv_id AS session_id, turn, unnest([struct_pack(path := '/type', token := '"response_item"'), struct_pack(path := '/timestamp', token := '"' || '2026-01-01T00:00:00Z' || '"'),
    struct_pack(path := '/payload/type', token := '"message"'), struct_pack(path := '/payload/role', token := {role}), struct_pack(path := '/payload/text', token := {text})]) AS s FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    tokens AS (SELECT session_id, s.path AS path, s.token AS token FROM t WHERE strlen(s.token) >= {least})""".format(role=ESCAPED.format("coalesce(role, '')"), text=ESCAPED.format("coalesce(text, '')"), least=FIELD_BYTES)
STATS = "sum(n)::BIGINT AS object_count, count(*) AS unique_objects, sum(size * n)::BIGINT AS total_bytes, sum(size)::BIGINT AS unique_bytes, sum(n - 1)::BIGINT AS duplicate_occurrences, sum(size * (n - 1))::BIGINT AS duplicate_bytes"


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.observations(layers.field_layer(conversation_records(spark, sf_dir), FIELD_BYTES))


@query(f"WITH {TOKENS}, o AS (SELECT sha256(token) AS digest, strlen(token)::BIGINT AS size, count(*) AS n FROM tokens GROUP BY ALL) SELECT 'field' AS layer, {STATS} FROM o")
def field_layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.layer_stats(_fields(spark, sf_dir))


@query(f"WITH {TOKENS} SELECT path, count(*) AS fields, sum(strlen(token))::BIGINT AS field_bytes FROM tokens GROUP BY path")
def field_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.paths(layers.field_layer(conversation_records(spark, sf_dir), FIELD_BYTES))


@query(f"""WITH o AS (SELECT sha256(token) AS digest, strlen(token)::BIGINT AS size, count(*) AS n FROM (SELECT {ESCAPED.format("coalesce(html, '')")} AS token FROM pages UNION ALL SELECT {ESCAPED.format("coalesce(url, '')")} FROM pages)
    WHERE strlen(token) >= {PAGE_FIELD_BYTES} GROUP BY ALL) SELECT 'field' AS layer, {STATS} FROM o""")
def page_field_layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.layer_stats(dedup.observations(layers.field_layer(page_records(spark, sf_dir), PAGE_FIELD_BYTES)))


@query(f"WITH RECURSIVE texts AS (SELECT doc_id AS session_id, coalesce(text, '') AS data FROM documents), {cdc('texts', BOUNDS)}, o AS (SELECT digest, size, count(*) AS n FROM cdc GROUP BY ALL) SELECT 'cdc' AS layer, {STATS} FROM o")
def cdc_layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return dedup.layer_stats(dedup.observations(layers.cdc_layer(docs, "doc_id", "text", BOUNDS)))


@query(f"""WITH RECURSIVE {CONVERSATION}, {TOKENS}, {cdc('whole', BOUNDS)}, o AS (SELECT 'cdc' AS layer, digest, size, count(*) AS n FROM cdc GROUP BY ALL UNION ALL SELECT 'record', sha256(record), strlen(record)::BIGINT, count(*) FROM talk GROUP BY ALL
    UNION ALL SELECT 'field', sha256(token), strlen(token)::BIGINT, count(*) FROM tokens GROUP BY ALL) SELECT layer, {STATS} FROM o GROUP BY layer""")
def all_layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three layers of the conversations' sessions, side by side."""
    records = conversation_records(spark, sf_dir)
    whole = records.groupBy("session_id").agg(F.expr("listagg(record) WITHIN GROUP (ORDER BY rec_idx)").alias("data"))
    seen = dedup.observations(dedup.record_layer(records)).unionByName(dedup.observations(layers.field_layer(records, FIELD_BYTES))).unionByName(dedup.observations(layers.cdc_layer(whole, "session_id", "data", BOUNDS)))
    return dedup.layer_stats(seen)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_records(spark, sf_dir).groupBy("session_id").agg(F.expr("listagg(record) WITHIN GROUP (ORDER BY rec_idx)").alias("data"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_parts(_sessions(spark, sf_dir), "session_id", "data", SETTINGS)


@query()
def fold_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).drop("bytes", "stored_bytes")


@query(f"WITH {CONVERSATION} SELECT session_id, sha256(data) AS digest, strlen(data)::BIGINT AS raw_bytes, session_id % 3 <> 0 AS verified FROM whole")
def fold_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the unfolded parts are, and whether that is the source; every third source has changed since."""
    sessions = _sessions(spark, sf_dir)
    parts = stage(fold.fold_parts(sessions, "session_id", "data", SETTINGS), "parts")
    changed = sessions.withColumn("data", F.when(F.col("session_id") % 3 == 0, F.concat("data", F.lit(" "))).otherwise(F.col("data")))
    back = fold.unfold(parts).select("session_id", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("raw_bytes"))
    return back.join(fold.verify(parts, changed, "session_id", "data").select("session_id", "verified"), "session_id")


@query(f'''WITH {TOKENS}, o AS (SELECT token, count(*) AS n FROM tokens GROUP BY token) SELECT 'field' AS kind, sum(n)::BIGINT AS parts, count(*) AS "unique", sum(n - 1)::BIGINT AS reused, sum(strlen(token))::BIGINT AS unique_raw_bytes FROM o''')
def fold_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.reuse(_parts(spark, sf_dir)).where("kind = 'field'").drop("new_stored_bytes")


#: Manifests: a part for each record of a document.
MANIFEST = RECORDS + ", parts AS (SELECT session_id, rec_idx AS part_idx, sha256(record) AS sha256, strlen(record)::BIGINT AS raw_bytes, record FROM records)"
STORED = "objects AS (SELECT DISTINCT sha256(record) AS sha256, strlen(record)::BIGINT AS raw_bytes, record FROM records)"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = document_records(spark, sf_dir)
    return r.select("session_id", F.col("rec_idx").alias("part_idx"), F.lit("residual").alias("kind"), F.sha2("record", 256).alias("sha256"), F.octet_length("record").cast("long").alias("raw_bytes"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = document_records(spark, sf_dir)
    return r.select(F.sha2("record", 256).alias("sha256"), F.octet_length("record").cast("long").alias("raw_bytes"), F.to_binary("record", F.lit("utf-8")).alias("bytes")).dropDuplicates(["sha256"])


@query(f"WITH {MANIFEST}, {STORED} SELECT sha256, raw_bytes FROM objects WHERE sha256 NOT IN (SELECT sha256 FROM parts WHERE session_id % 4 <> 0)")
def orphan_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of all documents, of which every fourth has lost its manifest."""
    return fold.orphans(_objects(spark, sf_dir).drop("bytes"), _manifest(spark, sf_dir).where("session_id % 4 <> 0"))


@query(f"""WITH {MANIFEST} SELECT session_id, part_idx, CASE WHEN sha256 LIKE 'a%' THEN 'missing_object' ELSE 'size_mismatch' END AS issue FROM parts WHERE sha256 LIKE 'a%' OR session_id % 11 = 1""")
def fold_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of manifests whose sizes are off in some sessions, against a store that lacks some objects."""
    manifest = _manifest(spark, sf_dir).withColumn("raw_bytes", F.col("raw_bytes") + (F.col("session_id") % 11 == 1).cast("long"))
    return fold.doctor(manifest, _objects(spark, sf_dir).where("sha256 NOT LIKE 'a%'"))


@query(f"WITH {MANIFEST}, p AS (SELECT sha256, raw_bytes + (session_id % 11 = 1)::BIGINT AS raw_bytes FROM parts) SELECT sha256, min(raw_bytes)::BIGINT AS raw_bytes, count(*) AS refs, min(raw_bytes) <> max(raw_bytes) AS conflict FROM p GROUP BY sha256")
def pack_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.references(_manifest(spark, sf_dir).withColumn("raw_bytes", F.col("raw_bytes") + (F.col("session_id") % 11 == 1).cast("long")))


@query(f"""WITH {RECORDS}, {STORED}, c AS (SELECT sha256, raw_bytes, unnest(range((raw_bytes + 63) // 64)) AS block_idx FROM objects)
    SELECT sha256, block_idx, block_idx * 64 AS raw_offset, least(64, raw_bytes - block_idx * 64)::BIGINT AS raw_bytes FROM c""")
def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.blocks(_objects(spark, sf_dir), 64).select("sha256", "block_idx", "raw_offset", "raw_bytes")


@query(f"""WITH RECURSIVE {RECORDS}, {STORED}, c AS (SELECT sha256, raw_bytes, unnest(range((raw_bytes + 1023) // 1024)) AS block_idx FROM objects),
    b AS (SELECT left(sha256, 2) AS shard, sha256, block_idx, least(1024, raw_bytes - block_idx * 1024)::BIGINT AS stored_bytes, row_number() OVER (PARTITION BY left(sha256, 2) ORDER BY sha256, block_idx) AS k FROM c),
    p AS (SELECT shard, sha256, block_idx, stored_bytes, k, 0::BIGINT AS pack, 0::BIGINT AS pack_offset FROM b WHERE k = 1
        UNION ALL SELECT b.shard, b.sha256, b.block_idx, b.stored_bytes, b.k, p.pack + (p.pack_offset + p.stored_bytes + b.stored_bytes > 16384)::BIGINT, CASE WHEN p.pack_offset + p.stored_bytes + b.stored_bytes > 16384 THEN 0 ELSE p.pack_offset + p.stored_bytes END
        FROM p JOIN b ON b.shard = p.shard AND b.k = p.k + 1) SELECT shard, sha256, block_idx, stored_bytes, pack, pack_offset FROM p""")
def pack_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = pack.blocks(_objects(spark, sf_dir), 1024).select("sha256", "block_idx", F.col("raw_bytes").alias("stored_bytes"), F.substring("sha256", 1, 2).alias("shard"))
    return pack.rotate(sizes, 16384, "shard")


@query(f"""WITH {RECORDS} SELECT doc_id AS session_id, 100::BIGINT AS lo, 300::BIGINT AS hi, octet_length(encode(text)[101:300])::BIGINT AS n, sha256(encode(text)[101:300]) AS digest FROM documents WHERE octet_length(encode(text)) > 100""")
def view_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = document_records(spark, sf_dir)
    parts = r.select("session_id", F.col("rec_idx").alias("part_idx"), F.sha2("record", 256).alias("sha256"), F.octet_length("record").cast("long").alias("raw_bytes"))
    ranges = r.select("session_id").distinct().select("session_id", F.lit(100).cast("long").alias("lo"), F.lit(300).cast("long").alias("hi"))
    read = pack.read_ranges(ranges, pack.view(parts), _objects(spark, sf_dir))
    return read.select("session_id", "lo", "hi", F.octet_length("data").cast("long").alias("n"), F.sha2("data", 256).alias("digest"))


FILES = """f AS (SELECT doc_id, doc_id // 2 AS inode, CASE doc_id % 9 WHEN 0 THEN '/store/objects/ab/' || doc_id || '.zst' WHEN 1 THEN '/store/packs/generations/g' || doc_id % 4 || '/p' || doc_id || '.pack' WHEN 2 THEN '/store/manifests/generations/' || doc_id || '.json'
    WHEN 3 THEN '/store/tmp/.object-' || doc_id WHEN 4 THEN '/store/fs/retired/' || doc_id WHEN 5 THEN '/store/fs/snapshots/' || doc_id WHEN 6 THEN '/store/fs/fallbacks/' || doc_id || '/fallback-current.jsonl' WHEN 7 THEN '/store/fs/sessions/' || doc_id || '/delta' ELSE '/store/notes/' || doc_id END AS path,
    coalesce(strlen(text), 0)::BIGINT AS size, doc_id % 5000 AS mtime FROM documents)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    kinds = [
        F.concat(F.lit("/store/objects/ab/"), i, F.lit(".zst")), F.concat(F.lit("/store/packs/generations/g"), (F.col("doc_id") % 4).cast("string"), F.lit("/p"), i, F.lit(".pack")), F.concat(F.lit("/store/manifests/generations/"), i, F.lit(".json")),
        F.concat(F.lit("/store/tmp/.object-"), i), F.concat(F.lit("/store/fs/retired/"), i), F.concat(F.lit("/store/fs/snapshots/"), i), F.concat(F.lit("/store/fs/fallbacks/"), i, F.lit("/fallback-current.jsonl")), F.concat(F.lit("/store/fs/sessions/"), i, F.lit("/delta")), F.concat(F.lit("/store/notes/"), i),
    ]
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return d.select("doc_id", F.expr("doc_id div 2").alias("inode"), F.get(F.array(*kinds), (F.col("doc_id") % 9).cast("int")).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), (F.col("doc_id") % 5000).alias("mtime"))


@query(f"""WITH {FILES}, c AS (SELECT *, CASE doc_id % 9 WHEN 0 THEN 'unique_loose_objects' WHEN 1 THEN CASE WHEN doc_id % 4 = 3 THEN 'packs' ELSE 'old_generations' END WHEN 2 THEN 'old_generations' WHEN 3 THEN 'unowned_temporary' WHEN 4 THEN 'retirement_state'
        WHEN 5 THEN 'retained_snapshots' WHEN 6 THEN 'current_fallbacks' WHEN 7 THEN 'active_deltas' ELSE 'metadata' END AS class, row_number() OVER (PARTITION BY inode ORDER BY path) AS r FROM f)
    SELECT class, count(*) AS files, sum(size)::BIGINT AS apparent_bytes, coalesce(sum(size) FILTER (WHERE r = 1), 0)::BIGINT AS physical_bytes, count(*) FILTER (WHERE r > 1) AS aliases FROM c GROUP BY class""")
def inventory_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).withColumn("owner", F.when(F.col("doc_id") % 9 == 7, "delta"))
    return store.inventory(f.withColumn("class", store.file_class("/store", F.col("path"), F.col("owner"), "g3")))


@query(f"""WITH {FILES}, c AS (SELECT path, inode, size, 1 + (inode % 3 = 0)::INT AS links FROM f WHERE doc_id % 9 = 3 AND mtime <= 4000), g AS (SELECT inode, count(*) AS n, max(links) AS links, min(path) AS first, max(size) AS size FROM c GROUP BY inode)
    SELECT path, CASE WHEN n = g.links AND path = first THEN g.size ELSE 0 END::BIGINT AS reclaimable_bytes FROM c JOIN g USING (inode)""")
def reclaimable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = store.temporary_candidates(_files(spark, sf_dir), 7600, 3600)
    return store.reclaimable(f.withColumn("links", 1 + (F.col("inode") % 3 == 0).cast("int")))


@query("""WITH g AS (SELECT doc_id % 50 AS session_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id // 50 END AS sequence, doc_id AS mtime, 'm' || doc_id AS name, 12 AS current_sequence FROM documents),
    s AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM g), old AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY (sequence IS NULL), sequence DESC, mtime DESC, name DESC) AS r FROM s WHERE n > 1 AND (sequence < 12 OR sequence IS NULL))
    SELECT session_id, name FROM s WHERE n > 1 AND sequence > 12 UNION ALL SELECT session_id, name FROM old WHERE r > 1""")
def generation_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    g = d.select((F.col("doc_id") % 50).alias("session_id"), F.when(F.col("doc_id") % 7 != 0, F.expr("doc_id div 50")).alias("sequence"), F.col("doc_id").alias("mtime"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("name"), F.lit(12).cast("long").alias("current_sequence"))
    return store.manifest_candidates(g, 2).select("session_id", "name")


@query("""WITH r AS (SELECT doc_id, doc_id * 3 AS current_bytes, coalesce(strlen(text), 0)::BIGINT AS persistent_bytes, (coalesce(strlen(text), 0) * 2)::BIGINT AS temporary_bytes, (coalesce(strlen(text), 0) // 2)::BIGINT AS overlap_bytes, doc_id * 2 AS reclaimable_bytes, 9000::BIGINT AS available_bytes FROM documents),
    p AS (SELECT *, current_bytes + persistent_bytes + temporary_bytes - overlap_bytes AS peak_bytes, current_bytes + persistent_bytes - least(reclaimable_bytes, current_bytes + persistent_bytes) AS final_bytes, available_bytes - (persistent_bytes + temporary_bytes - overlap_bytes) AS free_after_peak FROM r)
    SELECT doc_id, peak_bytes, final_bytes, free_after_peak, array_to_string(list_filter([CASE WHEN peak_bytes > 8000 THEN 'physical_budget' END, CASE WHEN temporary_bytes > 6000 THEN 'temporary_budget' END, CASE WHEN free_after_peak < 500 THEN 'free_space_reserve' END], lambda x: x IS NOT NULL), ',') AS rejections FROM p""")
def budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    r = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") * 3).alias("current_bytes"), n.alias("persistent_bytes"), (n * 2).alias("temporary_bytes"), F.floor(n / 2).cast("long").alias("overlap_bytes"), (F.col("doc_id") * 2).alias("reclaimable_bytes"), F.lit(9000).cast("long").alias("available_bytes")
    )
    return store.check_budget(r, 8000, 6000, 500).select("doc_id", "peak_bytes", "final_bytes", "free_after_peak", F.array_join("rejections", ",").alias("rejections"))


NOW = 1_000_000
CATALOG = f"""c AS (SELECT doc_id, doc_id::VARCHAR AS id, doc_id AS updated_at, doc_id % 3 = 0 AS archived, coalesce(strlen(text), 0)::BIGINT AS size, {NOW} - doc_id * 40 AS mtime FROM documents)"""
REASONS = f"""x AS (SELECT *, doc_id % 5 <> 1 AS seen, doc_id % 5 <> 1 AND doc_id % 7 <> 2 AS same, CASE WHEN doc_id % 5 <> 1 AND doc_id % 7 <> 2 THEN {NOW} - doc_id * 20 ELSE {NOW} END AS since FROM c),
    r AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'already_managed' ELSE array_to_string(list_filter([CASE WHEN NOT archived THEN 'not_archived' END, CASE WHEN doc_id % 19 = 0 THEN 'writer_active' END,
        CASE WHEN NOT seen THEN 'stability_pending' WHEN NOT same THEN 'file_changed' WHEN {NOW} - since < 3600 OR {NOW} - mtime < 3600 THEN 'stability_pending' END], lambda v: v IS NOT NULL), ',') END AS reasons FROM x)"""


@query(f"""WITH RECURSIVE {CATALOG}, {REASONS}, q AS (SELECT id, size, row_number() OVER (ORDER BY updated_at, id) AS k FROM r WHERE reasons = ''),
    w AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS id, 0::BIGINT AS used, 0 AS taken, NULL::VARCHAR AS reason UNION ALL
        SELECT q.k, q.id, CASE WHEN v.fits AND w.taken < 8 THEN v.more ELSE w.used END, w.taken + (v.fits AND w.taken < 8)::INT, CASE WHEN NOT v.fits THEN 'insufficient_budget' WHEN w.taken >= 8 THEN 'batch_limit' END
        FROM w JOIN q ON q.k = w.k + 1, LATERAL (SELECT w.used + 3 * (q.size + q.size // 16 + 1048576) AS more, 40000000 - (w.used + 3 * (q.size + q.size // 16 + 1048576) + q.size) >= 10000000 AS fits) v)
    SELECT r.id, coalesce(w.reason, r.reasons) AS reasons, r.reasons = '' AND w.reason IS NULL AS selected FROM r LEFT JOIN w ON r.id = w.id""")
def enrollment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    i, size = F.col("doc_id").cast("string"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sessions = d.select("doc_id", i.alias("id"), F.concat(F.lit("/s/"), i).alias("rollout_path"), F.col("doc_id").alias("updated_at"), (F.col("doc_id") % 3 == 0).alias("archived"), size.alias("size"), (F.lit(NOW) - F.col("doc_id") * 40).alias("mtime"))
    previous = sessions.where("doc_id % 5 <> 1").select(F.col("id").alias("session_id"), F.col("rollout_path").alias("path"), (F.col("size") + (F.col("doc_id") % 7 == 2).cast("long")).alias("size"), "mtime", (F.lit(NOW) - F.col("doc_id") * 20).alias("stable_since"))
    managed, writers = (sessions.where(f"doc_id % {k} = 0").select(F.col("id").alias("session_id")) for k in (17, 19))
    plan = enroll.decisions(sessions, previous, managed, writers, enroll.Policy(NOW, 3600, 8, True), budget=enroll.Budget(available=40_000_000, reserve=10_000_000))
    return plan.select("id", F.array_join("reasons", ",").alias("reasons"), "selected")


@query("SELECT doc_id, strlen(text)::BIGINT AS size, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 5 = 0 OR doc_id % 6 = 0")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files new (every fifth) or touched (every sixth) between two listings."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    before = d.where("doc_id % 5 <> 0").withColumn("mtime", F.lit(0))
    after = d.withColumn("mtime", F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0))
    return preflight.changed(before, after, "doc_id", ["size", "mtime"])


TRACE_KINDS = ["open", "RdData[A]", "operation=sync", "io=read", "fcntl <SETLK>", "fstatat64", "nothing"]
TRACE = """l AS (SELECT event_id, event_id % 7 AS k FROM events),
    n AS (SELECT event_id, k, CASE k WHEN 0 THEN 'open' WHEN 1 THEN 'read' WHEN 2 THEN 'fsync' WHEN 4 THEN 'fcntl' WHEN 5 THEN 'fstat' ELSE '' END AS name FROM l)"""


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in TRACE_KINDS])
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.concat(F.lit("12:00 "), F.get(kinds, (F.col("event_id") % 7).cast("int")), F.lit(" F=3 (R_____X) /x/"), F.col("event_id").cast("string")).alias("line"))


@query(f"WITH {TRACE} SELECT name, count(*) AS count, min(event_id) AS first_line FROM n WHERE name <> '' GROUP BY name")
def trace_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.contract(_trace(spark, sf_dir))


@query(f"WITH {TRACE}, s AS (SELECT name, unnest(CASE WHEN k = 4 THEN ['<SETLK>', '(R_____X)'] ELSE ['(R_____X)'] END) AS signature FROM n WHERE name <> '') SELECT name, signature, count(*) AS count FROM s GROUP BY ALL")
def trace_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.signatures(_trace(spark, sf_dir))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value", (50, 95, 99))


@query(f"WITH {OBJECTS}, o AS (SELECT size, occurrences AS n FROM objects) SELECT 'record' AS layer, {STATS} FROM o")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the first half of each document's lines, then of the tails: the same statistics as one scan of all."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mtime", F.lit(2))
    lines = F.split("text", "\n")
    half = F.slice(lines, F.lit(1), F.expr("size(split(text, '\n')) div 2"))
    first = d.withColumn("text", F.when(F.size(half) > 0, F.concat(F.array_join(half, "\n"), F.lit("\n"))).otherwise("")).withColumn("mtime", F.lit(1))
    state = stage(incremental.scan_state(first), "state")
    seen = dedup.observations(dedup.record_layer(incremental.split_records(first, "session_id", "text")))
    return dedup.layer_stats(incremental.record_tail(incremental.plan(d, state), stage(seen, "observations")))


@query("""WITH s AS (SELECT user_id AS session_id, (event_id % 400) * 10 AS start, (event_id % 400) * 10 + 5 + event_id % 13 AS "end" FROM events WHERE user_id IS NOT NULL),
    f AS (SELECT *, CASE WHEN start > max("end") OVER w OR max("end") OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY session_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY start, "end")::BIGINT AS island FROM f)
    SELECT session_id, island, min(start) AS start, max("end") AS "end" FROM i GROUP BY ALL""")
def append_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    start = (F.col("event_id") % 400) * 10
    return appends.islands(e.select(F.col("user_id").alias("session_id"), start.alias("start"), (start + 5 + F.col("event_id") % 13).alias("end")))


@query("""WITH j AS (SELECT user_id AS operation, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'prepared' WHEN 1 THEN 'published' ELSE 'complete' END AS phase FROM events WHERE user_id IS NOT NULL),
    l AS (SELECT operation, max_by(phase, seq) AS phase, max(seq) AS seq FROM j GROUP BY operation) SELECT operation, phase, CASE phase WHEN 'published' THEN 'complete' WHEN 'prepared' THEN 'roll_back' ELSE 'none' END AS action, seq FROM l""")
def journal_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    phase = F.get(F.array(F.lit("prepared"), F.lit("published"), F.lit("complete")), (F.col("event_id") % 3).cast("int"))
    return incremental.recovered(e.select(F.col("user_id").alias("operation"), F.col("event_id").alias("seq"), phase.alias("phase")))


@query("""WITH t AS (SELECT conv_id AS session_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
    SELECT session_id, session_id % 5 <> 0 AND session_id % 7 <> 0 AS complete, CASE WHEN session_id % 7 = 0 THEN 1 WHEN session_id % 5 = 0 THEN max(turn) + 1 END::BIGINT AS line, CASE WHEN session_id % 7 = 0 THEN 'invalid_json' WHEN session_id % 5 = 0 THEN 'no_newline' END AS issue FROM t GROUP BY session_id""")
def preflight_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of which every fifth lacks its last newline, and every seventh has a first line that isn't JSON."""
    r = conversation_records(spark, sf_dir)
    last = r.groupBy("session_id").agg(F.max("rec_idx").alias("last"), F.min("rec_idx").alias("first"))
    r = r.join(last, "session_id")
    text = F.when((F.col("session_id") % 7 == 0) & (F.col("rec_idx") == F.col("first")), F.concat(F.lit("}"), "record"))
    text = text.when((F.col("session_id") % 5 == 0) & (F.col("rec_idx") == F.col("last")), F.rtrim("record", F.lit("\n"))).otherwise(F.col("record"))
    r = r.select("session_id", "rec_idx", text.alias("record"))
    return preflight.complete_jsonl(r).join(preflight.first_issue(r), "session_id", "left")


@query("""SELECT doc_id, sha256(encode(text)[1:64]) AS head, sha256(encode(text)[greatest(octet_length(encode(text)) - 63, 1):octet_length(encode(text))]) AS tail FROM documents WHERE text IS NOT NULL""")
def window_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = preflight.window_fingerprint(F.to_binary("text", F.lit("utf-8")), 64)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", f.alias("f")).select("doc_id", "f.head", "f.tail")


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KiB', n / 1024.0) ELSE printf('%.2f MiB', n / 1048576.0) END AS size FROM (SELECT doc_id, strlen(text)::BIGINT * 64 AS n FROM documents WHERE text IS NOT NULL)""")
def formatted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", text_functions.format_bytes(F.octet_length("text").cast("long") * 64).alias("size"))
