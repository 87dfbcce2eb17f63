"""Stores, cycles and rules that the registered queries don't reach."""

import hashlib
import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.operators import collect, dedup, enroll, pack, reconcile, repair, sequence
from logloom.operators.folds import ordered_fold
from logloom.plans import catalog
from logloom.sources import shared, sinks, stores
from logloom.streaming import incremental, maintenance


def test_session_states(spark, tmp_path):
    assert stores.session_states(spark, f"{tmp_path}/none").count() == 0
    for name, state in (("b", {"session_id": "b", "generation": 2, "base_bytes": 5}), ("a", {"session_id": "a", "generation": 1, "base_bytes": 0, "delta_bytes": 3})):
        (tmp_path / "fs" / name).mkdir(parents=True)
        (tmp_path / "fs" / name / "state.json").write_text(json.dumps(state, indent=1))
    assert [tuple(r) for r in stores.session_states(spark, f"{tmp_path}/fs").collect()] == [("a", 1, 0, 3, None), ("b", 2, 5, None, None)]
    for bad in ({"session_id": "other", "generation": 1}, {"session_id": "b", "generation": 0}, {"session_id": "b", "generation": 1, "delta_bytes": -1}, {}):
        (tmp_path / "fs" / "b" / "state.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="invalid state in b"):
            stores.session_states(spark, f"{tmp_path}/fs").collect()


def test_contracts_and_audits(spark, tmp_path):
    operations = spark.createDataFrame([("read", 3), ("open", 1)], "name string, count long")
    folder = stores.save_contract(spark, f"{tmp_path}/c", "mac os", "../client", "1.0", operations)
    assert folder == f"{tmp_path}/c/mac-os_..-client_1.0"
    with pytest.raises(ValueError):
        stores.save_contract(spark, f"{tmp_path}/c", "p", "..", "1", operations)
    (row,) = stores.load_contracts(spark, f"{tmp_path}/c").collect()
    assert (row["platform"], row["kind"], row["version"], [(o["name"], o["count"]) for o in row["operations"]]) == ("mac os", "../client", "1.0", [("open", 1), ("read", 3)])
    retired = spark.createDataFrame([("aa", 5), ("bb", 6)], "sha256 string, raw_bytes long")
    assert stores.load_audit(spark, f"{tmp_path}/audit").count() == 0
    for generation, at in (("g1", 10), ("g2", 20), ("g2", 20)):  # the second of g2 is a retry
        stores.audit_retirement(retired, f"{tmp_path}/audit", generation, at)
    assert sorted(map(tuple, stores.load_audit(spark, f"{tmp_path}/audit").collect())) == [(10, "aa", 5, "g1"), (10, "bb", 6, "g1"), (20, "aa", 5, "g2"), (20, "bb", 6, "g2")]


def test_enrollment_cycles_see_stability_grow(spark, tmp_path):
    sessions = spark.createDataFrame([("s", "/s/s", 1, True, 100, 0)], "id string, rollout_path string, updated_at long, archived boolean, size long, mtime long")
    none = spark.createDataFrame([], "session_id string")
    outcome = []
    for now in (10_000, 11_000, 14_000):
        (row,) = maintenance.enrollment_cycle(sessions, none, none, f"{tmp_path}/seen", enroll.Policy(now, 3600)).collect()
        outcome.append((list(row["reasons"]), row["selected"]))
    assert outcome == [(["stability_pending"], False), (["stability_pending"], False), ([], True)]


def test_cycles_come_round(spark, tmp_path):
    numbers = []
    ticking = maintenance.every(spark, 0.2, numbers.append, f"{tmp_path}/checkpoint").start()
    end = time.time() + 60
    while len(numbers) < 3 and time.time() < end:
        time.sleep(0.1)
    ticking.stop()
    assert numbers[:3] == [0, 1, 2]
    a, b = (spark.createDataFrame(rows, "session_id string, generation long") for rows in ([("x", 1), ("y", 1), ("z", 1)], [("y", 2), ("z", 1), ("w", 1)]))
    assert sorted(map(tuple, maintenance.routes_changed(a, b).collect())) == [("w", "added"), ("x", "removed"), ("y", "moved")]


def test_integrity_misses_no_conversation_record(spark):
    talk = lambda who, said: json.dumps({"timestamp": None, "type": "response_item", "payload": {"type": "message", "role": who, "said": said}})
    rows = [(1, 0, talk("user", "a")), (1, 1, "{}"), (1, 2, talk("assistant", "b")), (2, 0, "{}")]
    source = spark.createDataFrame(rows, "session_id long, rec_idx long, record string")
    intact = lambda out: {r["session_id"]: r["intact"] for r in reconcile.integrity(source, out).collect()}
    assert intact(source.where("record <> '{}'")) == {1: True, 2: True}
    assert intact(source.where("rec_idx < 2")) == {1: False, 2: True}
    assert intact(source.withColumn("rec_idx", -F.col("rec_idx"))) == {1: False, 2: True}


def test_pairs_that_differ_in_their_meta_alone_are_identical(spark):
    meta = lambda i: f'{{"type":"session_meta","id":{i}}}\n'
    sessions = {1: [meta(1), "a\n", "b\n"], 2: [meta(2), "a\n", "b\n"], 3: ["a\n", "b\n", "c\n"], 4: [meta(4)], 5: [meta(4)]}
    records = spark.createDataFrame([(s, i, r) for s, rs in sessions.items() for i, r in enumerate(rs)], "session_id long, rec_idx long, record string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (4, 5)], "left_id long, right_id long")
    found = {(r["left_id"], r["right_id"]): r["relation"] for r in sequence.pair_relation(pairs, records).collect()}
    assert found == {(1, 2): "identical", (1, 3): "left_contained", (3, 2): "right_contained", (4, 5): "unknown"}


def test_rules_of_layers_pruning_and_proofs(spark):
    assert dedup.normalize_layers(" ") == dedup.LAYERS and dedup.normalize_layers("record, cdc") == ("cdc", "record")
    for bad in (",", " , ", "chunks"):
        with pytest.raises(ValueError):
            dedup.normalize_layers(bad)
    assert incremental.may_prune(True, True, False) and not any([incremental.may_prune(False, True, False), incremental.may_prune(True, False, False), incremental.may_prune(True, True, True), incremental.may_prune(True, True, False, limit=1), incremental.may_prune(True, True, False, byte_cap=1)])
    catalog = spark.createDataFrame([("a", True), ("b", True)], "id string, archived boolean")
    held = spark.createDataFrame([("a", "z"), ("b", "z"), ("gone", "z")], "needle_id string, container_id string")
    issues = spark.createDataFrame([("b", 0, "gap")], "session_id string, part_idx long, issue string")
    verified = spark.createDataFrame([("a", 1, True), ("b", 1, True)], "session_id string, raw_bytes long, verified boolean")
    source = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "session_id string, size long, known_size long")
    assert {r["session_id"]: r["proven"] for r in collect.removal_proof(catalog, held, issues, verified, source).collect()} == {"a": True, "b": False, "gone": False}


def test_folds_start_anew_for_each_key_and_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(k, i, i) for k in ("a", "b", None) for i in range(10)], "k string, at long, n long").repartition(4)

        def add(state, n):
            state[0] += n
            return state[0]

        got = {(r["k"], r["at"]): r["sum"] for r in ordered_fold(rows, ["k"], ["at"], ["n"], lambda: [0], add, "sum", "bigint").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, i): i * (i + 1) // 2 for k in ("a", "b", None) for i in range(10)}


def test_intermediate_tables_are_deleted(spark):
    with shared.scratch(spark):
        gone, kept = shared.stage(spark.range(3), "gone"), shared.stage(spark.range(4), "kept", keep=True)
        paths = [df.inputFiles()[0] for df in (gone, kept)]
    assert kept.count() == 4 and [stores.exists(spark, p) for p in paths] == [False, True]
    with shared.collecting() as outer:
        with shared.scratch(spark):
            shared.stage(spark.range(3), "inner", keep=True)
        assert len(outer) == 1 and stores.exists(spark, outer[0])
    shared.delete(spark, outer * 2)
    assert not stores.exists(spark, outer[0])


def test_live_ranges_past_ends(spark):
    states = spark.createDataFrame([(1, None, bytearray(b"base"), bytearray(b"delta")), (2, bytearray(b"backing"), bytearray(b"x"), None), (3, None, None, None)], "session_id long, backing binary, base binary, delta binary")
    ranges = spark.createDataFrame([(i, lo, hi) for i in (1, 2, 3) for lo, hi in ((0, 100), (2, 6), (4, 5), (50, 60), (3, 3))], "session_id long, lo long, hi long")
    whole = {1: b"basedelta", 2: b"backing", 3: b""}
    for r in pack.read_visible(ranges, states).collect():
        assert bytes(r["data"]) == whole[r["session_id"]][r["lo"] : r["hi"]]


def test_sessions_and_repairs_are_written_in_order(spark, tmp_path):
    data = [("a", b'{"timestamp":1,"x":"ab\n{"n":1}\ncd"}\n{"m":2}\n'), ("b", b'lost\n{"k":1}\r\n')]
    done = repair.repaired(spark.createDataFrame(data, "s string, d binary"), "s", "d", allow_orphans=True)
    sinks.write_repaired(done, f"{tmp_path}/out")
    read = lambda kind, s: "".join(p.read_text() for p in sorted((tmp_path / "out" / kind / f"session_id={s}").glob("part-*")))
    assert read("records", "a") == '{"timestamp":1,"x":"abcd"}\n{"n":1}\n{"m":2}\n' and read("records", "b") == '{"k":1}\n' and read("orphans", "b") == "lost\n"
    assert spark.read.parquet(f"{tmp_path}/out/errors").count() == 0
    many = spark.createDataFrame([(s, i, f"{s} {i}\n") for s in "xy" for i in range(500)], "session_id string, rec_idx long, record string").repartition(7)
    sinks.write_sessions(many, f"{tmp_path}/many")
    for s in "xy":
        (part,) = (tmp_path / "many" / f"session_id={s}").glob("part-*")
        assert part.read_text() == "".join(f"{s} {i}\n" for i in range(500))


def test_pack_generation_is_healthy_and_indexed(spark, tmp_path):
    raw = [bytes([i % 256]) * (200 * i + 1) for i in range(1, 30)] + [bytes(range(256)) * 3]
    objects = spark.createDataFrame([(bytearray(b),) for b in raw], "bytes binary").withColumn("sha256", F.sha2("bytes", 256))
    sinks.write_packs(objects, f"{tmp_path}/g1", block_bytes=1000, limit=5000)
    blocks = sinks.read_packs(spark, f"{tmp_path}/g1")
    parts = objects.select(F.lit("s").alias("session_id"), "sha256", F.octet_length("bytes").cast("long").alias("raw_bytes"))
    assert pack.pack_doctor(blocks, parts).count() == 0
    assert sorted(bytes(r["bytes"]) for r in pack.packed_objects(blocks).collect()) == sorted(raw)
    index = sinks.read_index(spark, f"{tmp_path}/g1")
    assert index.count() == sum(-(-len(b) // 1000) for b in raw) and "bytes" not in index.columns
    assert {r["encoding"] for r in index.select("encoding").distinct().collect()} == {"raw", "zstd"}
    assert index.groupBy("shard", "pack").agg(F.sum("stored_bytes").alias("n"), F.count("*").alias("c")).where("n > 5000 AND c > 1").count() == 0
    assert pack.pack_doctor(blocks.where("block_idx <> 1"), parts).where("issue IN ('gap', 'wrong_digest', 'size_mismatch')").count() > 0


def test_pack_doctor_takes_sizes_from_the_index(spark):
    """damaged bytes are of any size, and say nothing about what a manifest's part should measure."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    objects = {name: name.encode() * 10 for name in ("good", "longer", "short", "index")}
    packed = {"good": objects["good"], "longer": objects["longer"] + b"?", "short": objects["short"][:-1], "index": objects["index"]}
    rows = [(sha(b), 0, 0, len(b) + (name == "index"), sha(b if name != "short" else packed[name]), bytearray(packed[name])) for name, b in objects.items()]
    blocks = spark.createDataFrame(rows, "sha256 string, block_idx int, raw_offset long, raw_bytes long, block_sha256 string, bytes binary")
    parts = [(f"{name} {more}", sha(b), len(b) + more) for name, b in objects.items() for more in (-1, 0, 1)] + [("none", sha(b""), 1)]
    found = pack.pack_doctor(blocks, spark.createDataFrame(parts, "session_id string, sha256 string, raw_bytes long"))
    names = {sha(b): name for name, b in objects.items()}
    assert sorted((r["subject"], names.get(r["id"], r["id"]), r["issue"]) for r in found.collect()) == sorted(
        [("object", "longer", "damaged_block"), ("object", "short", "wrong_digest"), ("object", "index", "wrong_digest"), ("manifest", "none", "missing_object")]
        + [("manifest", f"{name} {more}", "size_mismatch") for name in ("good", "longer", "short") for more in (-1, 1)]
        + [("manifest", f"index {more}", "size_mismatch") for more in (-1, 0)]
    )


def test_pack_doctor_query_equals_sql_where_all_records_of_a_session_are_damaged(spark, tmp_path):
    """a session's only record is damaged by as many bytes as its manifest is wrong; and odd rows."""
    find = lambda first, make: next(t for t in map(make, range(10_000)) if hashlib.sha256(t.encode()).hexdigest()[0] == first)
    short, tail, other = lambda i: f"record {i}", lambda i: f"{i:068d}", lambda i: f"{i:064d}other"
    texts = [(12, find("c", short)), (23, find("d", tail)), (7, find("d", other)), (34, find("a", short)), (45, find("b", tail)), (56, find("e", short))]
    texts += [(1, None), (100, ""), (12, "again\n\n"), (None, find("a", tail)), (None, "x"), (-10, find("c", tail)), (9, find("c", short)), (8, "\n")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = [(r["subject"], r["id"], r["issue"]) for r in catalog.queries()["pack_doctor"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(con.execute(catalog.oracle_sql()["pack_doctor"]).fetchall(), key=repr)
    assert {("manifest", "12", "size_mismatch"), ("manifest", "23", "size_mismatch")} <= set(found)


def test_pack_doctor_query_checks_healthy_manifests(spark, tmp_path, monkeypatch):
    """all parts of all sessions are asked for, and not those alone that have an issue."""
    asked = []
    doctor = pack.pack_doctor
    monkeypatch.setattr(pack, "pack_doctor", lambda blocks, parts: asked.append(parts) or doctor(blocks, parts))
    spark.createDataFrame([(i, f"{i}\nlast") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    catalog.queries()["pack_doctor"](spark, str(tmp_path))
    assert asked[0].count() == 40
