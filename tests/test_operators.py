import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import dedup, enroll, fold, graph, layers, pack, preflight, reconcile, repair, select, sequence, store, trace
from logloom.functions.cdc import Bounds
from logloom.sources.tables import split_records
from logloom.streaming import appends, incremental


def records(spark, sessions):
    return split_records(spark.createDataFrame(list(sessions.items()), "s string, t string"), "s", "t")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_records_with_and_without_final_newline(spark):
    got = rows(records(spark, {"a": "x\n\ny", "b": "", "c": "\n", "d": None}), "session_id", "rec_idx", "record")
    assert got == [("a", 0, "x\n"), ("a", 1, "\n"), ("a", 2, "y"), ("c", 0, "\n")]


def test_layer_stats_formulas(spark):
    seen = spark.createDataFrame([("s", "record", "r", 100, 3, "/payload/output"), ("t", "record", "u", 20, 1, "")], "session_id string, layer string, digest string, size long, occurrences long, sample_path string")
    assert tuple(dedup.layer_stats(seen).first()) == ("record", 4, 2, 320, 120, 2, 200)
    assert rows(dedup.top_objects(seen, 1), "digest", "sample_path") == [("r", "/payload/output")]
    assert dedup.top_objects(seen, 0).isEmpty()
    assert dedup.normalize_layers(" Record, cdc") == ("cdc", "record")
    with pytest.raises(ValueError):
        dedup.normalize_layers("lines")


def test_field_layer_keeps_the_spelling(spark):
    r = records(spark, {"a": '{"value":"same\\n"}\n{"value":"same\\u000a"}\nnot json\n', "b": '{"value":"same\\n"}'})
    seen = dedup.observations(layers.field_layer(r, 4))
    assert dedup.layer_stats(seen).first()["unique_objects"] == 2 and dedup.layer_stats(seen).first()["object_count"] == 3
    assert layers.field_layer(r, 4, max_line=5).isEmpty()


def test_selection(spark):
    c = spark.createDataFrame([("a", "T1", "x", 20, False), ("b", "T2", "y", 8, True), ("c", "t3", "z", 3, False)], "id string, title string, cwd string, size long, archived boolean")
    assert rows(select.greedy_within(c, 10), "id") == [("b",)]
    assert rows(select.greedy_within(c, 11), "id") == [("b",), ("c",)]
    assert rows(select.search(c, " T "), "id") == [("a",), ("b",), ("c",)] and rows(select.search(c, ""), "id") == [("a",), ("b",), ("c",)]
    with pytest.raises(LookupError):
        select.by_ids(select.unarchived(c), ["b"])
    for wrong in ((True, ["a"], ""), (False, [], " ")):
        with pytest.raises(ValueError):
            select.validate_selector(*wrong)


def test_pair_relations(spark):
    r = records(spark, {"l1": "a\nb\n", "r1": "a\nb\n", "l2": "a\nb\n", "r2": "x\na\nb\ny\n", "l3": "a\nb\n", "r3": "a\nc\n", "l4": "p\n", "r4": "q\n", "l5": "1\n2\n", "r5": "1\ngap\n2\n"})
    pairs = spark.createDataFrame([(f"l{i}", f"r{i}") for i in range(1, 6)], "left_id string, right_id string")
    got = rows(sequence.pair_relation(pairs, r), "left_id", "relation", "prefix", "shared")
    assert got == [("l1", "identical", 2, 2), ("l2", "left_contained", 0, 2), ("l3", "independent_tails", 1, 1), ("l4", "unknown", 0, 0), ("l5", "independent_tails", 1, 2)]


def test_containment_against_brute_force(spark):
    r = random.Random(5)
    sessions = {str(i): "".join(r.choice("ab") + "\n" for _ in range(r.randrange(1, 6))) for i in range(30)}
    want = sorted((a, b, min(i for i in range(len(y)) if y[i : i + len(x)] == x) // 2) for a, x in sessions.items() for b, y in sessions.items() if a != b and x in y)
    assert rows(sequence.containment(records(spark, sessions)), "needle_id", "container_id", "at") == want


def test_meta_records_keep_the_index(spark):
    r = sequence.without_meta(records(spark, {"a": '{"type":"session_meta","id":1}\nfirst\n', "b": "first\n"}))
    assert rows(r, "session_id", "rec_idx") == [("a", 1), ("b", 0)]
    assert rows(sequence.containment(r), "needle_id", "container_id") == [("a", "b"), ("b", "a")]


def test_family(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 9), (7, 8)], "parent_id long, child_id long")
    ids = spark.createDataFrame([(1,), (2,), (3,), (7,), (8,)], "id long")
    assert rows(graph.family(edges, ids, 2), "node", "in_catalog") == [(1, True), (2, True), (3, True), (9, False)]
    assert rows(graph.relation(edges, ids, 2), "node", "relation") == [(1, "ancestor"), (2, "seed"), (3, "descendant"), (7, "none"), (8, "none")]
    with pytest.raises(LookupError):
        graph.family(edges, ids, 99)


def _branch(spark, seconds):
    return spark.createDataFrame([("s", i, t, str(t), 1) for i, t in enumerate(seconds)], "session_id string, seq long, epoch_ns long, digest string, size long")


def test_merge(spark):
    base, branch = _branch(spark, [0, 2]), _branch(spark, [0, 1, 2, 2])
    assert tuple(reconcile.analyze(base, branch).first()) == ("s", 2, 0, 2, 4)
    merged = reconcile.merge(base, branch)
    assert [r["epoch_ns"] for r in merged.orderBy("ord").collect()] == [0, 1, 2, 2]
    assert reconcile.verify_merge(merged, reconcile.analyze(base, branch)).first()["ok"]
    assert reconcile.regressions(_branch(spark, [1, 0, 5])).first()["regressions"] == 1


def test_timestamps(spark):
    texts = ["2026-01-01T00:00:00.123456789Z", "2026-01-01T01:00:00+01:00", "nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reconcile.epoch_ns(F.col("t"))).collect()]
    assert got == [1767225600123456789, 1767225600000000000, None, None]
    with pytest.raises(Exception, match="record 7 has no timestamp"):
        spark.range(1).select(reconcile.required_timestamp(F.lit("x"), F.lit(7))).collect()


def test_fold_round_trip(spark):
    cases = {"empty": "", "bad": "not-json", "big": '{"v":"' + "x" * 4096 + '"}', "two": '{"a":"shared-value","n":1}\n{"n":2,"a":"shared-value"}\n'}
    sessions = spark.createDataFrame(list(cases.items()), "id string, data string")
    settings = fold.FoldSettings(8, Bounds(8, 16, 32), max_line=64)
    parts = fold.fold_parts(sessions, "id", "data", settings).cache()
    assert all(r["verified"] for r in fold.verify(parts, sessions, "id", "data").collect())
    kinds = {r["kind"]: r for r in fold.reuse(parts).collect()}
    assert kinds["field"]["parts"] == 2 and kinds["field"]["reused"] == 1
    assert rows(fold.unfold(parts).select("session_id", F.col("data").cast("string").alias("d")), "session_id", "d") == sorted((k, v) for k, v in cases.items() if v)


def test_record_promotion(spark):
    line = '{"a":"' + "a" * 300 + '","b":"' + "b" * 300 + '"}\n'
    r = records(spark, {"s": line + "{}\n" + line})
    settings = fold.FoldSettings(8, Bounds(8, 16, 32), record_bytes=100)
    seen = dedup.observations(dedup.record_layer(r))
    found = {x["digest"] for x in fold.promotions(r, dedup.duplicate_records(seen), settings).collect()}
    sessions = spark.createDataFrame([("s", line + "{}\n" + line)], "id string, data string")
    parts = fold.fold_parts(sessions, "id", "data", settings, frozenset(found)).cache()
    assert fold.verify(parts, sessions, "id", "data").first()["verified"]
    assert parts.where("kind = 'record'").count() == 2 * len(found)


def test_objects_are_put_once(spark, tmp_path):
    parts = fold.fold_parts(spark.createDataFrame([("s", "abc\nabc\n")], "id string, data string"), "id", "data")
    path = f"file://{tmp_path}/objects"
    assert fold.put_objects(parts, path).count() == 1 and fold.put_objects(parts, path).count() == 0
    assert fold.orphans(spark.read.parquet(path), parts.limit(0)).count() == 1
    with pytest.raises(ValueError):
        fold.orphans(spark.read.parquet(path), parts, 1)


def test_pack(spark):
    sizes = spark.createDataFrame([("a", 0, 6), ("b", 0, 6), ("c", 0, 30), ("d", 0, 1)], "sha256 string, block_idx long, stored_bytes long")
    assert rows(pack.rotate(sizes, 10), "sha256", "pack", "pack_offset") == [("a", 0, 0), ("b", 1, 0), ("c", 2, 0), ("d", 3, 0)]
    e = spark.createDataFrame([(8192, 8200), (100, 60), (100, 49), (100000, 99999)], "raw long, z long").select(pack.encoding(F.col("raw"), F.col("z")).alias("e"))
    assert [r["e"] for r in e.collect()] == ["raw", "raw", "zstd", "zstd"]
    index = spark.createDataFrame([("a", 0, 0, 5, 8), ("a", 1, 5, 3, 8), ("b", 0, 1, 2, 3), ("c", 0, 0, 2, 3)], "sha256 string, block_idx long, raw_offset long, raw_bytes long, object_bytes long")
    assert rows(pack.index_issues(index), "sha256", "issue") == [("b", "gap"), ("c", "wrong_total")]


def test_range_reads(spark):
    data = b"alpha-" + b"x" * 33 + b"-gamma-" + b"delta" * 17
    sessions = spark.createDataFrame([("s", data.decode())], "id string, data string")
    parts = fold.fold_parts(sessions, "id", "data", fold.FoldSettings(8, Bounds(8, 8, 16))).cache()
    r = random.Random(42)
    wanted = sorted({tuple(sorted((r.randrange(len(data)), r.randrange(1, len(data) + 20)))) for _ in range(60)})
    wanted = [(a, b) for a, b in wanted if a < b]
    got = pack.read_ranges(spark.createDataFrame([("s", *w) for w in wanted], "session_id string, lo long, hi long"), pack.view(parts.drop("bytes")), parts.dropDuplicates(["sha256"]))
    assert {(x["lo"], x["hi"]): bytes(x["data"]) for x in got.collect()} == {(a, b): data[a:b] for a, b in wanted}
    states = spark.createDataFrame([("a", b"x", b"y", None), ("b", b"x", None, b"zz")], "session_id string, base binary, delta binary, backing binary")
    assert [(bytes(r["data"]), r["size"]) for r in pack.visible(states).orderBy("session_id").collect()] == [(b"xy", 2), (b"zz", 2)]


def test_budget(spark):
    columns = "current_bytes long, persistent_bytes long, temporary_bytes long, overlap_bytes long, reclaimable_bytes long, available_bytes long"
    r = spark.createDataFrame([(100, 30, 80, 0, 70, 1000)], columns)
    got = store.check_budget(r).first()
    assert (got["peak_bytes"], got["final_bytes"], got["free_after_peak"], got["allowed"]) == (210, 60, 890, True)
    got = store.check_budget(spark.createDataFrame([(100, 80, 80, 80, 0, 1000)], columns), 170, 70, 930).first()
    assert (got["peak_bytes"], got["final_bytes"], got["free_after_peak"], got["rejections"]) == (180, 180, 920, ["physical_budget", "temporary_budget", "free_space_reserve"])
    with pytest.raises(Exception, match="impossible"):
        store.check_budget(spark.createDataFrame([(-1, 0, 0, 0, 0, 0)], columns)).collect()


def test_retention_and_hard_links(spark):
    g = spark.createDataFrame([("s", "gen-0", 0, 1, False, True), ("s", "gen-1", 1, 2, False, False), ("s", "gen-2", 2, 3, False, False), ("s", "gen-3", 3, 4, True, False)], "store string, name string, sequence long, mtime long, current boolean, leased boolean")
    assert rows(store.pack_candidates(g, 2), "name") == [("gen-1",)]
    c = spark.createDataFrame([("/a", 1, 2, 10), ("/b", 2, 1, 5), ("/c", 3, 2, 7), ("/d", 3, 2, 7)], "path string, inode long, links long, size long")
    assert rows(store.reclaimable(c), "path", "reclaimable_bytes") == [("/a", 0), ("/b", 5), ("/c", 7), ("/d", 0)]
    t = spark.createDataFrame([("/x/.object-1", 0), ("/x/.a.tmp2", 5000), ("/x/.hidden", 0), ("/x/a.tmp", 0)], "path string, mtime long")
    assert rows(store.temporary_candidates(t, 5000), "path") == [("/x/.object-1",)]
    r = spark.createDataFrame([("s", "r1", 1, 1), ("s", "r2", 2, 2), ("t", "r1", 1, 1)], "session_id string, name string, sequence long, mtime long")
    assert rows(store.retired_candidates(r, 1), "session_id", "name") == [("s", "r1")]


def test_enrollment_reasons(spark):
    now = 100_000
    s = spark.createDataFrame([(n, f"/s/{n}", i, True, 10, 0) for i, n in enumerate(["active", "changing", "managed", "writer", "batch-a", "batch-b", "a/b"])], "id string, rollout_path string, updated_at long, archived boolean, size long, mtime long")
    p = s.where("id <> 'active'").select(F.col("id").alias("session_id"), F.col("rollout_path").alias("path"), (F.col("size") + (F.col("id") == "changing").cast("long")).alias("size"), "mtime", F.lit(0).cast("long").alias("stable_since"))
    name = lambda x: spark.createDataFrame([(x,)], "session_id string")
    got = {r["id"]: (r["reasons"], r["selected"]) for r in enroll.decisions(s, p, name("managed"), name("writer"), enroll.Policy(now)).collect()}
    assert got == {"active": (["stability_pending"], False), "changing": (["file_changed"], False), "managed": (["already_managed"], False), "writer": (["writer_active"], False), "batch-a": ([], True), "batch-b": (["batch_limit"], False), "a/b": (["invalid_path"], False)}
    closed = enroll.decisions(s, p, name("managed"), name("writer"), enroll.Policy(now), enroll.Gates(mount_healthy=False)).where("id = 'batch-a'").first()
    assert closed["reasons"] == ["mount_unhealthy"]
    poor = enroll.decisions(s, p, name("managed"), name("writer"), enroll.Policy(now), budget=None).where("id = 'batch-a'").first()
    assert poor["reasons"] == ["insufficient_budget"]
    chosen = s.where("id LIKE 'batch%'")
    assert rows(enroll.apply_plan(chosen, s.withColumn("size", F.lit(11).cast("long")), name("batch-b"), 1), "id", "outcome") == [("batch-a", "skipped_changed")]


def test_trace(spark):
    lines = ["10:00 open F=3 (R__________X___) /a", "10:01 RdData[A] F=3", "10:02 fcntl <SETLK> F=3", "10:03 operation=sync x", "10:04 io=read", "10:05 pread F=3", "10:06 operation=wat"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert [r["name"] for r in trace.contract(df).orderBy("first_line").collect()] == ["open", "read", "fcntl", "fsync", "pread"]
    assert rows(trace.signatures(df), "name", "signature", "count") == [("fcntl", "<SETLK>", 1), ("open", "(R__________X___)", 1)]
    seen = spark.createDataFrame([("mac", "cli", "1"), ("mac", " ", "1"), ("mac", "cli", "2")], "platform string, kind string, version string")
    assert tuple(trace.evaluation(seen, seen.where("version = '1'")).first()) == (2, "quarantine")
    listing = spark.createDataFrame(list(enumerate(["p1", "f3", "au", "n/a (deleted)", "f4", "ar", "n/b", "p2", "f1", "n/c"])), "line_no long, line string")
    assert rows(trace.open_files(listing), "pid", "path", "writer") == [("1", "/a", True), ("1", "/b", False), ("2", "/c", False)]


def test_preflight(spark):
    r = records(spark, {"good": '{"a":1}\n', "bad": '{"a":1}\n{"a":\n\n', "open": '{"a":1}'})
    assert rows(preflight.first_issue(r), "session_id", "line", "issue") == [("bad", 2, "invalid_json"), ("open", 1, "no_newline")]
    assert rows(preflight.complete_jsonl(r), "session_id", "complete") == [("bad", False), ("good", True), ("open", False)]
    checks = spark.createDataFrame([("a", True, True), ("b", False, False)], "component string, ok boolean, blocking boolean")
    assert rows(preflight.health(checks, ["a", "b"]), "component", "level", "healthy") == [("a", "ok", True), ("b", "warning", True)]
    assert rows(preflight.health(checks, ["a", "b", "c"]), "component", "level")[2] == ("c", "error")


def test_repaired_sessions_with_errors(spark):
    s = spark.createDataFrame([("a", "{}\n"), ("b", "x"), ("c", None)], "id string, data string")
    assert rows(repair.repaired(s, "id", "data"), "session_id", "kind") == [("a", "record"), ("b", "error")]


def test_incremental_scan_equals_full_scan(spark):
    before = spark.createDataFrame([("a", "1\n2\n", 1), ("b", "x\n", 1), ("gone", "z\n", 1)], "session_id string, text string, mtime long")
    after = spark.createDataFrame([("a", "1\n2\n1\n", 2), ("b", "x\n", 1), ("c", "x\n1\n", 2)], "session_id string, text string, mtime long")
    observe = lambda s: dedup.observations(dedup.record_layer(split_records(s, "session_id", "text")))
    plan = incremental.strict(incremental.plan(after, incremental.scan_state(before)))
    assert rows(plan, "session_id", "mode") == [("a", "tail"), ("b", "skip"), ("c", "whole")]
    got = incremental.record_tail(plan, incremental.pruned(observe(before), after))
    assert rows(got, "session_id", "digest", "occurrences") == rows(observe(after), "session_id", "digest", "occurrences")
    for text in ("1\n", "9\n2\n3\n"):
        changed = spark.createDataFrame([("a", text, 2)], "session_id string, text string, mtime long")
        with pytest.raises(incremental.RebuildRequired):
            incremental.strict(incremental.plan(changed, incremental.scan_state(before)))


def test_append_buffer():
    assert appends.merge_segments(0, [(3, b"}\n"), (0, b'{"a":1}\n'[:0] + b"{  ")]) == (b"{  }\n", [])
    assert appends.merge_segments(5, [(9, b"{}\n"), (5, b"{}\n")]) == (b"{}\n", [(9, b"{}\n")])
    assert appends.merge_segments(0, [(0, b"{}\n{")])[1] == [(3, b"{")]
    with pytest.raises(appends.GapError):
        appends.merge_segments(0, [(0, b"{}\n"), (1, b"x")])
    with pytest.raises(appends.GapError):
        appends.merge_segments(0, [(4, b"x")], strict=True)


def test_contiguous_end(spark):
    s = spark.createDataFrame([("a", 10, 20), ("a", 25, 30), ("a", 20, 22), ("b", 5, 9)], "session_id string, start long, end long")
    c = spark.createDataFrame([("a", 10), ("b", 3)], "session_id string, size long")
    assert rows(appends.contiguous_end(s, c), "session_id", "end") == [("a", 22), ("b", 3)]
