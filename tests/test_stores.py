import pytest
from pyspark.sql import functions as F

from logloom.operators import fold
from logloom.sources import stores, tables
from logloom.streaming import appends, feeds


def test_manifests_round_trip_and_issues(spark, tmp_path):
    sessions = spark.createDataFrame([("s", "abc\n"), ("t", "abc\nd\n")], "id string, data string")
    parts = fold.fold_parts(sessions, "id", "data").drop("bytes", "start")
    path = f"file://{tmp_path}/manifests"
    stores.commit_manifests(parts, f"{path}/one", "2026-01-01T00:00:00Z")
    with pytest.raises(Exception, match="exists"):
        stores.commit_manifests(parts, f"{path}/one", "2026-01-01T00:00:00Z")
    (tmp_path / "manifests" / "bad.json").write_text('{"version":1,"kind":"manifest","parts":[{"kind":"record","sha256":"00"}]}')
    (tmp_path / "manifests" / "worse.json").write_text('{"version":9,"parts":[]}')
    loaded = stores.load_manifests(spark, f"{path}/bad.json").unionByName(stores.load_manifests(spark, f"{path}/worse.json"))
    assert sorted(r["issue"] for r in loaded.collect()) == ["unknown_part_kind", "unknown_version"]
    assert stores.load_manifests(spark, f"{path}/none").isEmpty()


def test_observations_pointer_and_journal(spark, tmp_path):
    path = f"file://{tmp_path}/seen"
    assert stores.load_observations(spark, path).isEmpty()
    for size in (1, 2):
        stores.save_observations(spark.createDataFrame([("s", "/s", size, 0, 0)], stores.OBSERVATION), path)
    assert [r["size"] for r in stores.load_observations(spark, path).collect()] == [2]
    assert stores.current(spark, f"file://{tmp_path}") is None
    for generation in ("g1", "g2"):
        stores.publish(spark, f"file://{tmp_path}", generation)
    assert stores.current(spark, f"file://{tmp_path}") == "g2"
    (tmp_path / "journal").write_text('{"seq":2,"operation":"a","phase":"published"}\n{"seq":1,"operation":"a","phase":"prepared"}\n')
    assert [r["seq"] for r in stores.load_journal(spark, f"file://{tmp_path}/journal").collect()] == [1, 2]
    (tmp_path / "x.zst").write_bytes(b"123")
    assert [r["size"] for r in stores.object_files(spark, f"file://{tmp_path}").collect()] == [3]


def test_sqlite_catalog(spark, tmp_path):
    import sqlite3

    file = str(tmp_path / "state.sqlite")
    with sqlite3.connect(file) as db:
        db.execute("CREATE TABLE threads (id, title, cwd, rollout_path, model_provider, model, git_branch, updated_at, archived)")
        db.executemany("INSERT INTO threads VALUES (?, 't', 'c', 'p', 'm', NULL, NULL, ?, ?)", [("a", 1, 0), ("b", 2, 5)])
    assert [(r["id"], r["model"], r["archived"]) for r in tables.sqlite_catalog(spark, file).collect()] == [("b", "", True), ("a", "", False)]
    assert tables.sqlite_edges(spark, file).isEmpty()


def test_append_stream_waits_for_gaps(spark, tmp_path):
    source = f"{tmp_path}/in"
    schema = "session_id string, start long, data binary"
    spark.createDataFrame([("s", 3, b"{}\n")], schema).write.parquet(f"{source}/a")
    spark.createDataFrame([("s", 0, b"{}\n")], schema).write.parquet(f"{source}/b")
    stream = appends.commit_stream(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source))
    run = stream.writeStream.format("memory").queryName("committed").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    run.processAllAvailable()
    run.stop()
    got = [(r["start"], bytes(r["data"])) for r in spark.table("committed").orderBy("start").collect()]
    assert b"".join(d for _, d in got) == b"{}\n{}\n" and got[0][0] == 0


def test_observation_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("x\nx\ny")
    run = feeds.observe_to(feeds.session_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").start()
    run.processAllAvailable()
    run.stop()
    seen = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["occurrences"], r["size"]) for r in seen.collect()) == [(1, 1), (2, 2)]
    listing = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size long, mtime long")
    assert [r["path"] for r in feeds.change_feed(listing, listing.withColumn("size", F.when(F.col("path") == "b", 2).otherwise(1).cast("long"))).collect()] == ["b"]
