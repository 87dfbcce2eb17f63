"""Queries over repair, retention, garbage, proofs, packs as artefacts, live views and incremental scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.cdc import Bounds
from logloom.operators import collect, dedup, fold, graph, layers, pack, reconcile, repair, select, sequence, store, trace
from logloom.plans.chunks import CONVERSATION, ESCAPED
from logloom.plans.dedup import OBJECTS, RECORDS
from logloom.plans.registry import query
from logloom.plans.relations import AROUND, EDGES, SEED
from logloom.plans.storage import STATS
from logloom.sources import sinks
from logloom.sources.shared import fresh_path, stage
from logloom.sources.tables import catalog, conversation_records, document_records, spawn_edges, table
from logloom.streaming import appends, feeds, incremental, maintenance

# ---------------------------------------------------------------- repair

#: Three records a document. By the id modulo 5: whole; A broken by B; A broken by B, which C breaks; a fragment of no
#: record first; and Windows line ends.
BROKEN = """a AS (SELECT doc_id, doc_id % 5 AS k, '{"timestamp":"a","id":' || doc_id || ',"text":"' || md5(coalesce(text, '')) || '"}' AS a, '{"timestamp":"b","id":' || doc_id || '}' AS b, '{"id":' || doc_id || ',"more":[1,{"x":null}]}' AS c FROM documents WHERE doc_id IS NOT NULL)"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    d = d.select("doc_id", F.concat(F.lit('{"timestamp":"a","id":'), i, F.lit(',"text":"'), F.md5(F.coalesce("text", F.lit(""))), F.lit('"}')).alias("a"), F.concat(F.lit('{"timestamp":"b","id":'), i, F.lit("}")).alias("b"), F.concat(F.lit('{"id":'), i, F.lit(',"more":[1,{"x":null}]}')).alias("c"))
    nl = F.lit("\n")
    a1, a2 = F.substring("a", 1, 20), F.substring("a", 21, 1 << 20)
    b1, b2 = F.substring("b", 1, 15), F.substring("b", 16, 1 << 20)
    data = F.array(
        F.concat("a", nl, "b", nl, "c", nl), F.concat(a1, nl, "b", nl, a2, nl, "c", nl), F.concat(a1, nl, b1, nl, "c", nl, b2, nl, a2, nl),
        F.concat(F.lit("lost "), i, nl, "a", nl, "b", nl, "c"), F.concat("a", F.lit("\r\n"), "b", F.lit("\r\n"), "c", F.lit("\r\n")),
    )
    return d.select("doc_id", F.get(data, (F.col("doc_id") % 5).cast("int")).alias("data"))


@query(f"""WITH {BROKEN}, r AS (SELECT doc_id, k, unnest([a, b, c]) AS record, unnest([0, 1, 2]) AS idx FROM a), o AS (SELECT doc_id, k, 'record' AS kind, idx, record FROM r UNION ALL SELECT doc_id, k, 'orphan', 0, 'lost ' || doc_id FROM a WHERE k = 3)
    SELECT doc_id AS session_id, kind, idx::BIGINT AS idx, sha256(record) AS digest, ([0, 2, 4, 1, 0])[k + 1]::BIGINT AS invalid_lines, ([0, 1, 2, 0, 0])[k + 1]::BIGINT AS reconstructed FROM o""")
def repaired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repair.repaired(_broken(spark, sf_dir), "doc_id", "data", allow_orphans=True)
    return done.select("session_id", "kind", "idx", F.sha2("record", 256).alias("digest"), "invalid_lines", "reconstructed")


@query(f"WITH {BROKEN} SELECT doc_id AS session_id, CASE WHEN k = 3 THEN 'error' ELSE 'record' END AS kind, CASE WHEN k = 3 THEN 1 ELSE 3 END AS rows FROM a")
def repair_without_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions where a fragment of no record is an error of its session alone."""
    done = repair.repaired(_broken(spark, sf_dir), "doc_id", "data")
    return done.groupBy("session_id", "kind").agg(F.count("*").alias("rows"))


STAMPED = """regexp_replace(rtrim(record, chr(10)), '^."type":"response_item","timestamp":"([^"]*)"', '{"timestamp":"\\1","type":"response_item"')"""


@query(f"""WITH {CONVERSATION}, s AS (SELECT session_id, rec_idx, role, {STAMPED} AS line FROM talk), d AS (SELECT session_id, list(sha256(line) ORDER BY rec_idx) FILTER (WHERE role IN ('user', 'assistant')) AS ds,
        list(sha256(line) ORDER BY rec_idx) FILTER (WHERE role IN ('user', 'assistant') AND (session_id % 4 <> 0 OR rec_idx > 0)) AS os FROM s GROUP BY session_id),
    c AS (SELECT session_id, list_reduce(list_concat([repeat('0', 64)], coalesce(ds, [])), lambda h, x: sha256(unhex(h || x))) AS source_chain, list_reduce(list_concat([repeat('0', 64)], coalesce(os, [])), lambda h, x: sha256(unhex(h || x))) AS output_chain FROM d)
    SELECT session_id, source_chain, output_chain, source_chain = output_chain AS intact FROM c""")
def repair_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first record is broken by a note, repaired; every fourth loses its first turn on the way."""
    stamped = F.regexp_replace("record", r'^."type":"response_item","timestamp":"([^"]*)"', '{"timestamp":"$1","type":"response_item"')
    source = conversation_records(spark, sf_dir).select("session_id", "rec_idx", F.rtrim(stamped, F.lit("\n")).alias("record"))
    first = F.col("rec_idx") == F.min("rec_idx").over(_per_session())
    line = F.when(first, F.concat(F.substring("record", 1, 30), F.lit('\n{"note":1}\n'), F.substring("record", 31, 1 << 24))).otherwise(F.col("record"))
    lines = source.withColumn("line", line).where("session_id % 4 <> 0 OR rec_idx > 0")
    sessions = lines.groupBy("session_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY rec_idx)").alias("data"))
    out = repair.repaired(sessions, "session_id", "data").where("kind = 'record'").select("session_id", F.col("idx").alias("rec_idx"), F.col("record").cast("string").alias("record"))
    return reconcile.integrity(source, out)


def _per_session():
    from pyspark.sql import Window as W

    return W.partitionBy("session_id")


# ---------------------------------------------------------------- retention and garbage

GENERATIONS = "SELECT doc_id, '/g/' || doc_id AS path, doc_id % 20 AS owner, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id // 20 END AS sequence, doc_id AS mtime, 'g' || doc_id AS name FROM documents"
PACKS = f"""p AS (SELECT *, doc_id % 20 = doc_id % 31 AS current, doc_id % 13 = 5 AS leased FROM ({GENERATIONS})), old_packs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY (sequence IS NULL), sequence DESC, mtime DESC, name DESC) AS r FROM p WHERE NOT current AND NOT leased) WHERE r > 1)"""
RETIRED = f"""old_retired AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY (sequence IS NULL), sequence DESC, mtime DESC, name DESC) AS r FROM ({GENERATIONS})) WHERE r > 1)"""


def _generations(spark: SparkSession, sf_dir: str, owner: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    return d.select("doc_id", F.concat(F.lit("/g/"), i).alias("path"), (F.col("doc_id") % 20).alias(owner), F.when(F.col("doc_id") % 7 != 0, F.expr("doc_id div 20")).alias("sequence"), F.col("doc_id").alias("mtime"), F.concat(F.lit("g"), i).alias("name"))


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generations(spark, sf_dir, "store").withColumns({"current": F.col("doc_id") % 20 == F.col("doc_id") % 31, "leased": F.col("doc_id") % 13 == 5})


@query(f"WITH {PACKS} SELECT owner AS store, name FROM old_packs")
def pack_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pack_candidates(_packs(spark, sf_dir), 2).select("store", "name")


@query(f"WITH {RETIRED} SELECT owner AS session_id, name FROM old_retired")
def retired_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.retired_candidates(_generations(spark, sf_dir, "session_id"), 1).select("session_id", "name")


@query("SELECT doc_id % 20 AS session_id, '/g/' || doc_id AS path FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 11 <> 4 AND doc_id % 20 <> 9")
def session_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session files of which every third is current, some are in the journal, and one session has a lease."""
    g = _generations(spark, sf_dir, "session_id")
    leases = g.where("session_id = 9").select("session_id").distinct()
    return store.session_candidates(g, g.where("doc_id % 3 = 0"), g.where("doc_id % 11 = 4"), leases).select("session_id", "path")


@query(f"""WITH {PACKS}, files AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN '/s/.object-' || doc_id ELSE '/g/' || doc_id END AS path, doc_id // 2 AS inode, CASE WHEN (doc_id // 2) % 3 = 0 THEN 1 ELSE 2 END AS links, coalesce(strlen(text), 0)::BIGINT AS size, doc_id AS mtime FROM documents),
    named AS (SELECT path, 0 AS place, 'pack' AS kind FROM old_packs WHERE doc_id % 6 <> 5 UNION ALL SELECT path, 2, 'session' FROM files WHERE doc_id % 6 <> 5 AND doc_id % 3 = 1 UNION ALL SELECT path, 4, 'temporary' FROM files WHERE doc_id % 6 = 5 AND mtime <= 400),
    once AS (SELECT path, min_by(kind, place) AS kind FROM named GROUP BY path), listed AS (SELECT * FROM once JOIN files USING (path)),
    i AS (SELECT inode, count(*) AS n, max(links) AS links, min(path) AS first, max(size) AS size FROM listed GROUP BY inode)
    SELECT l.kind, l.path, CASE WHEN i.n = i.links AND l.path = i.first THEN i.size ELSE 0 END::BIGINT AS reclaimable_bytes FROM listed l JOIN i USING (inode)""")
def garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of candidate at once; hard links tie packs, session files and temporary files together."""
    d = table(spark, sf_dir, "documents")
    temporary = F.col("doc_id") % 6 == 5
    files = d.select("doc_id", F.when(temporary, F.concat(F.lit("/s/.object-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("/g/"), F.col("doc_id").cast("string"))).alias("path"), F.expr("doc_id div 2").alias("inode"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.col("doc_id").alias("mtime"))
    files = files.withColumn("links", F.when(F.col("inode") % 3 == 0, 1).otherwise(2))
    packs = _packs(spark, sf_dir).where("doc_id % 6 <> 5")
    # as many old packs as when none is a temporary file: retention looks at generations, the listing at files
    packs = store.pack_candidates(_packs(spark, sf_dir), 2).join(packs.select("path"), "path", "left_semi").withColumns({"current": F.lit(False), "leased": F.lit(False), "store": F.col("path")})
    sessions = files.where(~temporary & (F.col("doc_id") % 3 == 1)).select("path", (F.col("doc_id") % 20).alias("session_id"))
    none = files.limit(0).select("path", F.col("doc_id").alias("session_id"), F.col("doc_id").alias("sequence"), "mtime", F.col("path").alias("name"), F.col("doc_id").alias("current_sequence"))
    return collect.garbage(files, packs, none, sessions, none, none, none, none, 4000, collect.Retention(temporary_grace=3600, packs=1))


@query("""WITH f AS (SELECT doc_id // 2 AS inode, max(CASE WHEN doc_id % 2 = 0 THEN coalesce(strlen(text), 0) END) AS even, max(CASE WHEN doc_id % 2 = 1 THEN coalesce(strlen(text), 0) END) AS odd FROM documents GROUP BY 1), s AS (SELECT sum(coalesce(even, odd))::BIGINT AS current_bytes FROM f)
    SELECT current_bytes, current_bytes + 1500 AS peak_bytes, current_bytes + 700 AS final_bytes, 48500::BIGINT AS free_after_peak, array_to_string(list_filter([CASE WHEN current_bytes + 1500 > 100000 THEN 'physical_budget' END, 'temporary_budget'], lambda x: x IS NOT NULL), ',') AS rejections FROM s""")
def storage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.lpad(F.col("doc_id").cast("string"), 20, "0")
    files = d.select(name.alias("path"), F.expr("doc_id div 2").alias("inode"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.lit("metadata").alias("class"))
    g = collect.guard(files, free=50_000, persistent=1000, temporary=900, overlap=400, reclaimable=300, max_physical=100_000, max_temporary=800, reserve=1000)
    return g.select("current_bytes", "peak_bytes", "final_bytes", "free_after_peak", F.array_join("rejections", ",").alias("rejections"))


HELD = """texts AS (SELECT session_id, count(*) AS n, list(sha256(record) ORDER BY rec_idx) AS hs FROM records GROUP BY ALL),
    spots AS (SELECT l.session_id AS needle_id, r.session_id AS container_id, l.n AS records, unnest(range(r.n - l.n + 1)) AS place, l.hs AS lh, r.hs AS rh FROM texts l JOIN texts r ON l.session_id <> r.session_id AND l.n <= r.n AND list_contains(r.hs, l.hs[1])),
    held AS (SELECT DISTINCT needle_id, container_id FROM spots WHERE rh[place + 1] = lh[1] AND rh[place + 1 : place + records] = lh)"""


@query(f"""WITH {RECORDS}, {HELD}, p AS (SELECT needle_id AS session_id, container_id, needle_id % 3 = 0 AS archived, needle_id % 11 <> 1 AS healthy, needle_id % 5 <> 0 AS unfolded, needle_id % 7 <> 2 AS unchanged FROM held)
    SELECT *, archived AND healthy AND unfolded AND unchanged AS proven FROM p""")
def removal_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contained sessions, some of them live, with sick manifests, with bytes that don't unfold, or changed since."""
    r, c = document_records(spark, sf_dir), catalog(spark, sf_dir).withColumn("id", F.col("updated_at"))
    parts = r.select("session_id", F.col("rec_idx").alias("part_idx"), F.lit("residual").alias("kind"), F.sha2("record", 256).alias("sha256"), (F.octet_length("record") + (F.col("session_id") % 11 == 1).cast("int")).cast("long").alias("raw_bytes"), F.to_binary("record", F.lit("utf-8")).alias("bytes"))
    objects = parts.select("sha256", F.octet_length("bytes").cast("long").alias("raw_bytes"), "bytes").dropDuplicates(["sha256"])
    texts = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    source = c.select(F.col("id").alias("session_id"), "size", (F.col("size") + (F.col("id") % 7 == 2).cast("long")).alias("known_size"))
    return collect.removal_proof(c, sequence.containment(r), fold.doctor(parts.drop("bytes"), objects), fold.verify(parts, texts, "doc_id", "text"), source)


# ---------------------------------------------------------------- packs as artefacts, live views


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = document_records(spark, sf_dir)
    objects = r.select(F.sha2("record", 256).alias("sha256"), F.to_binary("record", F.lit("utf-8")).alias("bytes")).dropDuplicates(["sha256"])
    return pack.blocks(objects, 64)


@query(f"""WITH {RECORDS}, o AS (SELECT DISTINCT sha256(record) AS id, strlen(record) AS n FROM records),
    p AS (SELECT DISTINCT session_id, CASE WHEN sha256(record) LIKE 'a%' THEN 'missing_object' WHEN session_id % 11 = 1 THEN 'size_mismatch' END AS issue FROM records WHERE sha256(record) LIKE 'a%' OR session_id % 11 = 1)
    SELECT 'object' AS subject, id, CASE WHEN id LIKE 'b%' AND n > 64 THEN 'gap' WHEN id LIKE 'c%' THEN 'damaged_block' ELSE 'wrong_digest' END AS issue FROM o WHERE id LIKE 'b%' AND n > 64 OR id LIKE 'c%' OR id LIKE 'd%' AND n > 64
    UNION ALL SELECT 'manifest', session_id::VARCHAR, issue FROM p""")
def pack_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs that lack objects (a), have offsets that leave a gap (b), damaged bytes (c) and wrong digests (d)."""
    b = _blocks(spark, sf_dir).where("sha256 NOT LIKE 'a%'")
    b = b.withColumn("raw_offset", F.when(F.col("sha256").startswith("b") & (F.col("block_idx") > 0), F.col("raw_offset") + 1).otherwise(F.col("raw_offset")))
    b = b.withColumn("bytes", F.when(F.col("sha256").startswith("c"), F.concat("bytes", F.lit(b"?"))).otherwise(F.col("bytes")))
    swapped = F.when(F.col("sha256").startswith("d") & (F.col("block_idx") == 1), F.concat(F.lit(b"other"), "bytes"))
    b = b.withColumns({"bytes": F.coalesce(swapped, F.col("bytes")), "block_sha256": F.coalesce(F.sha2(swapped, 256), F.col("block_sha256"))})
    parts = document_records(spark, sf_dir).select("session_id", F.sha2("record", 256).alias("sha256"), F.octet_length("record").cast("long").alias("raw_bytes"))
    parts = parts.withColumn("raw_bytes", F.col("raw_bytes") + (F.col("session_id") % 11 == 1).cast("long"))
    return pack.pack_doctor(b, parts)


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sessions: every fourth has a backing, the others a base of 100 bytes and the rest as delta."""
    data = F.to_binary(F.coalesce("text", F.lit("")), F.lit("utf-8"))
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("session_id"), data.alias("data"))
    live = F.col("session_id") % 4 == 0
    return d.select(
        "session_id", F.when(live, F.col("data")).alias("backing"), F.when(live, F.lit(b"old")).otherwise(F.substring("data", 1, 100)).alias("base"),
        F.when(live, F.lit(b"older")).when(F.octet_length("data") > 100, F.substring("data", 101, 1 << 24)).alias("delta"), F.col("session_id").alias("mtime"),
    )


@query("SELECT doc_id AS session_id, 60::BIGINT AS lo, 160::BIGINT AS hi, octet_length(encode(text)[61:160])::BIGINT AS n, sha256(encode(text)[61:160]) AS digest FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)")
def live_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges across the seam of base and delta."""
    states = _live(spark, sf_dir)
    read = pack.read_visible(states.select("session_id", F.lit(60).cast("long").alias("lo"), F.lit(160).cast("long").alias("hi")), states)
    return read.select("session_id", "lo", "hi", F.octet_length("data").cast("long").alias("n"), F.sha2("data", 256).alias("digest"))


@query("SELECT doc_id AS session_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256, doc_id % 6 + 1 AS generation, true AS verified FROM documents WHERE (doc_id % 4 = 0 OR octet_length(encode(coalesce(text, ''))) > 100) AND doc_id <= 400 AND doc_id % 9 <> 0")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle sessions with something to compact, of which every ninth is being written."""
    states = _live(spark, sf_dir)
    writers = states.where("session_id % 9 = 0").select("session_id")
    idle = maintenance.compactable(states, writers, now=1000, idle=600)
    generations = states.where("session_id % 6 <> 0").select("session_id", (F.col("session_id") % 6).alias("generation"))
    return maintenance.compacted(idle, generations).select("session_id", "size", "sha256", "generation", "verified")


@query("SELECT doc_id AS session_id, 0::BIGINT AS lo, octet_length(encode(text))::BIGINT AS hi FROM documents WHERE doc_id % 10 = 3 AND octet_length(encode(text)) > 0")
def shadow_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sessions read virtually, of which every tenth has another first byte; ranges that the seed draws agree elsewhere."""
    states = _live(spark, sf_dir)
    native = pack.visible(states)
    wrong = (F.col("session_id") % 10 == 3) & (F.octet_length("data") > 0)
    virtual = native.select("session_id", F.when(wrong, F.concat(F.lit(b"\x00"), F.substring("data", F.lit(2), F.lit(1 << 24)))).otherwise(F.col("data")).alias("data"))
    ranges = pack.shadow_ranges(native.select("session_id", "size"))
    read = ranges.join(virtual, "session_id").select("session_id", "lo", "hi", F.substring("data", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("data"))
    found = pack.shadow_compare(ranges, read, native)
    inside = found.where("lo > 0")  # only the first byte is wrong, so any range that begins later must agree
    whole = found.join(native.select("session_id", F.col("size").alias("hi")), ["session_id", "hi"], "left_semi").where("lo = 0")
    return whole.unionByName(inside).select("session_id", "lo", "hi").distinct()


@query(f"WITH {RECORDS} SELECT DISTINCT sha256(record) AS sha256 FROM records WHERE strlen(record) > 100")
def retirable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose objects that packs hold too: the packs have those above 100 bytes."""
    o = document_records(spark, sf_dir).select(F.sha2("record", 256).alias("sha256"), F.octet_length("record").alias("n")).distinct()
    return pack.retirable(o.select("sha256"), o.where("n > 100").select("sha256"), 0, 0)


@query("SELECT sum(CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 6 = 0 THEN 7 ELSE 30 END ELSE coalesce(strlen(text), 0) END)::BIGINT AS logical_bytes FROM documents WHERE doc_id IS NOT NULL")
def logical_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managed sessions count what they show, even where a manifest says otherwise."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("session_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("source_bytes"))
    states = d.where("session_id % 3 = 0").select("session_id", F.when(F.col("session_id") % 6 == 0, F.lit(7)).cast("long").alias("backing_bytes"), F.lit(10).cast("long").alias("base_bytes"), F.lit(20).cast("long").alias("delta_bytes"))
    return store.logical_bytes(states, d)


@query("""WITH o AS (SELECT DISTINCT 'p' || event_id % 3 AS platform, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END AS kind, (event_id % 5)::VARCHAR AS version FROM events)
    SELECT platform, kind, version FROM o WHERE trim(kind) = '' OR platform = 'p2' OR version = '4'""")
def unknown_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients without a contract: contracts are there for two platforms and four versions; blank kinds never have one."""
    i = F.col("event_id")
    seen = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), (i % 3).cast("string")).alias("platform"), F.when(i % 11 == 0, " ").otherwise(F.col("event_type")).alias("kind"), (i % 5).cast("string").alias("version")).distinct()
    return trace.unknown_clients(seen, seen.where("platform <> 'p2' AND version <> '4'"))


# ---------------------------------------------------------------- scans that go on

GROWN = "s AS (SELECT doc_id AS session_id, CASE doc_id % 6 WHEN 0 THEN 'skip' WHEN 1 THEN 'tail' WHEN 2 THEN 'rebuild' WHEN 3 THEN 'rebuild' WHEN 4 THEN 'whole' ELSE 'skip' END AS mode FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"


def _grown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """By the id modulo 6: as before; grown; changed in its beginning; grown after half a line; new; touched."""
    k = F.col("session_id") % 6
    now = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("session_id"), F.concat(F.lit("first\nsecond\n"), "text").alias("text"))
    before = now.where(k != 4).select("session_id", F.when(k == 1, "first\n").when(k == 2, F.concat(F.lit("Other\n"), F.substring("text", 7, 1 << 24))).when(k == 3, "first\nsec").otherwise(F.col("text")).alias("text"), F.lit(1).alias("mtime"))
    return before, now.withColumn("mtime", F.when(k.isin(2, 5), 2).otherwise(1))


@query(f"WITH {GROWN} SELECT * FROM s")
def scan_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _grown(spark, sf_dir)
    return incremental.plan(now, incremental.scan_state(before)).select("session_id", "mode")


@query(f"WITH {GROWN} SELECT session_id FROM s WHERE session_id % 6 = 1 OR session_id % 6 = 2 OR session_id % 6 = 3 OR session_id % 6 = 5")
def changed_during_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _grown(spark, sf_dir)
    listing = lambda s: incremental.scan_state(s).select("session_id", "size", "mtime", "prefix")
    return incremental.changed_during_scan(listing(before), listing(now))


FIELDS = """f AS (SELECT unnest([{a}, {b}]) AS token FROM documents WHERE doc_id IS NOT NULL), o AS (SELECT sha256(token) AS digest, strlen(token)::BIGINT AS size, count(*) AS n FROM f WHERE strlen(token) >= 16 GROUP BY ALL)""".format(a=ESCAPED.format("coalesce(source, '') || coalesce(lang, '') || 'first part of it'"), b=ESCAPED.format("md5(coalesce(text, ''))"))


@query(f"WITH {FIELDS} SELECT 'field' AS layer, {STATS} FROM o")
def incremental_fields_equal_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of two records, of which the second comes after the first scan."""
    lines = lambda c, name: F.concat(F.lit(f'{{"{name}":"'), c, F.lit('"}\n'))
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("session_id"), lines(F.concat(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.lit("first part of it")), "a").alias("a"), lines(F.md5(F.coalesce("text", F.lit(""))), "b").alias("b"))
    first, now = d.select("session_id", F.col("a").alias("text"), F.lit(1).alias("mtime")), d.select("session_id", F.concat("a", "b").alias("text"), F.lit(2).alias("mtime"))
    seen = stage(dedup.observations(incremental.sightings_after(incremental.plan(first, incremental.scan_state(first.limit(0))), "field", 16)), "observations")
    return dedup.layer_stats(incremental.layer_after(incremental.plan(now, incremental.scan_state(first)), seen, "field", 16))


@query()
def incremental_chunks_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk statistics of grown sessions beside those of a full scan; the two rows must agree."""
    bounds = Bounds(64, 256, 1024)
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("session_id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("a"))
    first, now = d.select("session_id", F.col("a").alias("text"), F.lit(1).alias("mtime")), d.select("session_id", F.concat("a", F.reverse("a")).alias("text"), F.lit(2).alias("mtime"))
    nothing = incremental.scan_state(first.limit(0))
    seen = stage(dedup.observations(incremental.sightings_after(incremental.plan(first, nothing), "cdc", 1, bounds)), "observations")
    grown = dedup.layer_stats(incremental.layer_after(incremental.plan(now, incremental.scan_state(first)), seen, "cdc", 1, bounds)).withColumn("layer", F.lit("incremental"))
    full = dedup.layer_stats(dedup.observations(layers.cdc_layer(now, "session_id", "text", bounds))).withColumn("layer", F.lit("full"))
    return grown.unionByName(full)


@query(f"WITH {OBJECTS}, k AS (SELECT sha256(record) AS digest, strlen(record)::BIGINT AS size, count(*) AS occurrences FROM records WHERE session_id % 5 <> 0 GROUP BY ALL), o AS (SELECT size, occurrences AS n FROM k) SELECT 'record' AS layer, {STATS} FROM o")
def pruned_layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the record layer when every fifth session has vanished."""
    seen = dedup.observations(dedup.record_layer(document_records(spark, sf_dir)))
    return dedup.layer_stats(incremental.pruned(seen, table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("session_id"))))


@query(f"""WITH {OBJECTS}, o AS (SELECT size, occurrences AS n FROM objects), s AS (SELECT {STATS} FROM o), r AS (SELECT *, round(duplicate_bytes::DOUBLE / total_bytes * 100, 2) AS p FROM s)
    SELECT 'record' AS layer, duplicate_bytes, p AS duplicate_percent, printf('record: %d objects, %d unique, %d duplicate bytes (%.2f%%)', object_count, unique_objects, duplicate_bytes, p) AS text FROM r""")
def scan_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = dedup.layer_stats(dedup.observations(dedup.record_layer(document_records(spark, sf_dir))))
    return dedup.report(stats, F.col("total_bytes")).select("layer", "duplicate_bytes", "duplicate_percent", "text")


# ---------------------------------------------------------------- families, lookups, text


@query(f"WITH RECURSIVE {EDGES}, {AROUND} SELECT DISTINCT parent_id, child_id FROM e WHERE parent_id IN (SELECT node FROM around) AND child_id IN (SELECT node FROM around)")
def family_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spawn_edges(spark, sf_dir)
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).where("id IS NOT NULL").distinct()
    return graph.family_edges(edges, graph.family(edges, ids, SEED))


@query(f"WITH RECURSIVE {EDGES}, {AROUND} SELECT node FROM around WHERE node NOT IN (SELECT id FROM ids WHERE id % 3 <> 1 OR id = {SEED})")
def family_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a family without a session of their own: every third is gone from the catalog."""
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).where(f"id % 3 <> 1 OR id = {SEED}").distinct()
    return graph.missing(graph.family(spawn_edges(spark, sf_dir), ids, SEED))


def _catalog_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("id", "size", "archived", "rollout_path")


@query("SELECT doc_id::VARCHAR AS id, coalesce(strlen(text), 0)::BIGINT AS size FROM documents WHERE doc_id IN (1, 7, 42)")
def select_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.by_ids(_catalog_ids(spark, sf_dir), ["7", "42", "1"]).select("id", "size")


@query("SELECT doc_id::VARCHAR AS id, coalesce(strlen(text), 0)::BIGINT AS size FROM documents WHERE doc_id = 42")
def select_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.session(_catalog_ids(spark, sf_dir), "42").select("id", "size")


@query(f"WITH {RECORDS}, n AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY rec_idx) - 1 AS ord, sha256(record) AS digest FROM records) SELECT session_id, ord, digest FROM n")
def record_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of sessions that begin with a meta record, which isn't one of them."""
    r = document_records(spark, sf_dir)
    meta = r.select("session_id").distinct().select("session_id", F.lit(0).cast("long").alias("rec_idx"), F.lit('{"type":"session_meta"}\n').alias("record"))
    return sequence.numbered(sequence.without_meta(meta.unionByName(r.withColumn("rec_idx", F.col("rec_idx") + 1)))).select("session_id", "ord", "digest")


@query("""WITH s AS (SELECT user_id AS session_id, event_id % 400 * 10 AS start, event_id % 400 * 10 + 5 + event_id % 13 AS stop FROM events WHERE user_id IS NOT NULL),
    r AS (SELECT session_id, start, stop, max(stop) OVER (PARTITION BY session_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), g AS (SELECT session_id, min(start) AS gap FROM r WHERE start > greatest(coalesce(before, 0), 100) GROUP BY session_id)
    SELECT session_id, greatest(100, coalesce(max(r.stop) FILTER (WHERE g.gap IS NULL OR r.start < g.gap), 0))::BIGINT AS "end" FROM r LEFT JOIN g USING (session_id) GROUP BY session_id""")
def contiguous_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far appends that came out of order reach without a gap from the 100 bytes that are committed."""
    start = (F.col("event_id") % 400) * 10
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("session_id"), start.alias("start"), (start + 5 + F.col("event_id") % 13).alias("end"))
    return appends.contiguous_end(e, e.select("session_id", F.lit(100).alias("size")).distinct())


@query("""WITH r AS (SELECT user_id AS cache, event_id AS seen, event_type || (event_id % 97) AS block, 10 + event_id % 97 AS size FROM events WHERE user_id IS NOT NULL), l AS (SELECT cache, block, max(seen) AS seen, max(size) AS size FROM r WHERE size <= 80 GROUP BY cache, block),
    u AS (SELECT *, sum(size) OVER (PARTITION BY cache ORDER BY seen DESC, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM l) SELECT cache, block, size FROM u WHERE used <= 500""")
def cached_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    reads = e.select(F.col("user_id").alias("cache"), F.col("event_id").alias("at"), F.concat("event_type", (F.col("event_id") % 97).cast("string")).alias("block"), (10 + F.col("event_id") % 97).alias("size"))
    return pack.cached_blocks(reads, 500, 80, "cache")


@query("SELECT CASE WHEN doc_id % 4 = 3 THEN '/moved/' ELSE '/n/' END || doc_id AS path, CASE doc_id % 4 WHEN 1 THEN 'changed' WHEN 3 THEN 'added' ELSE 'retry' END AS change FROM documents WHERE doc_id % 4 IN (1, 3) OR doc_id % 8 = 0 UNION ALL SELECT '/n/' || doc_id, 'removed' FROM documents WHERE doc_id % 4 = 3")
def namespace_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they were, touched, or moved; every eighth and some that changed anew couldn't be applied last time."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    before = d.select("doc_id", F.concat(F.lit("/n/"), i).alias("path"), F.octet_length("text").alias("size"), F.lit(1).alias("mtime"))
    moved = F.col("doc_id") % 4 == 3
    after = before.withColumns({"path": F.when(moved, F.concat(F.lit("/moved/"), i)).otherwise(F.col("path")), "mtime": F.when(F.col("doc_id") % 4 == 1, 2).otherwise(1)})
    return feeds.namespace_delta(before, after, before.where("doc_id % 8 = 0 OR doc_id % 8 = 1").select("path"))


@query(f"WITH {RECORDS} SELECT DISTINCT sha256(record) AS sha256, strlen(record)::BIGINT AS raw_bytes FROM records")
def packs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of all documents, written as packs of encoded blocks and put together again; sick ones would be missing."""
    r = document_records(spark, sf_dir)
    objects = r.select(F.sha2("record", 256).alias("sha256"), F.to_binary("record", F.lit("utf-8")).alias("bytes")).dropDuplicates(["sha256"])
    path = fresh_path(spark, "packs")
    sinks.write_packs(objects, path, 64, 65_536, shard_digits=1)
    back = pack.packed_objects(sinks.read_packs(spark, path))
    return back.where(F.sha2("bytes", 256) == F.col("sha256")).select("sha256", "raw_bytes")
