"""Relations between record sequences: shared records, shared prefix, contiguous containment, pair classes.

Records are keyed by (digest, size); the bytes are compared wherever two keys meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def without_meta(records: DataFrame) -> DataFrame:
    """Records without a leading session_meta object; the others keep their index."""
    meta = (F.col("rec_idx") == 0) & F.coalesce(F.get_json_object("record", "$.type") == "session_meta", F.lit(False))
    return records.where(~meta)


def numbered(records: DataFrame) -> DataFrame:
    """(session_id, ord, n, digest, size, record): the record's ordinal among its session's ``n`` records."""
    by = W.partitionBy("session_id")
    return records.select(
        "session_id", (F.row_number().over(by.orderBy("rec_idx")) - 1).cast("long").alias("ord"), F.count("*").over(by).alias("n"),
        F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("size"), "record",
    )


def offsets(records: DataFrame) -> DataFrame:
    """Byte ranges of the records: ``start`` and ``end`` added."""
    size = F.octet_length("record").cast("long")
    end = F.sum(size).over(W.partitionBy("session_id").orderBy("rec_idx"))
    return records.withColumn("end", end).withColumn("start", F.col("end") - size)


def shared_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(left_id, right_id, shared): records in common, each matched once. Pairs without any have 0."""
    counts = records.groupBy("session_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").alias("size")).agg(F.count("*").alias("n"))
    left = pairs.join(counts.select(F.col("session_id").alias("left_id"), "digest", "size", F.col("n").alias("l")), "left_id")
    both = left.join(counts.select(F.col("session_id").alias("right_id"), "digest", "size", F.col("n").alias("r")), ["right_id", "digest", "size"])
    found = both.groupBy("left_id", "right_id").agg(F.sum(F.least("l", "r")).alias("shared"))
    return pairs.select("left_id", "right_id").join(found, ["left_id", "right_id"], "left").select("left_id", "right_id", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


def shared_prefix(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(left_id, right_id, prefix): how many leading records are equal."""
    r = numbered(records)
    left = pairs.join(r.select(F.col("session_id").alias("left_id"), "ord", F.col("n").alias("nl"), F.col("record").alias("x")), "left_id")
    both = left.join(r.select(F.col("session_id").alias("right_id"), "ord", F.col("n").alias("nr"), F.col("record").alias("y")), ["right_id", "ord"])
    first = F.min(F.when(F.col("x") != F.col("y"), F.col("ord")))
    found = both.groupBy("left_id", "right_id").agg(F.coalesce(first, F.least(F.max("nl"), F.max("nr"))).alias("prefix"))
    return pairs.select("left_id", "right_id").join(found, ["left_id", "right_id"], "left").select("left_id", "right_id", F.coalesce("prefix", F.lit(0)).cast("long").alias("prefix"))


def _anchors(needle: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle_id, records, anchor, digest, size): the record of each needle that is rarest among the haystacks."""
    df = hay.groupBy("digest", "size").agg(F.count("*").alias("seen"))
    rarity = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("ord"), F.col("digest"), F.col("size"))
    found = needle.join(df, ["digest", "size"], "left").groupBy("session_id").agg(F.min(rarity).alias("a"), F.max("n").alias("n"))
    return found.select(F.col("session_id").alias("needle_id"), F.col("n").alias("records"), F.col("a.ord").alias("anchor"), F.col("a.digest").alias("digest"), F.col("a.size").alias("size"))


def _along(diagonals: DataFrame, needle: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle_id, container_id, records, at): the first place of those where all records are equal.

    Digests and sizes decide who is compared in full; the bytes are then compared at places that match throughout.
    """
    at = diagonals.where("needle_id <> container_id AND at >= 0 AND at + records <= length").select("needle_id", "container_id", "records", "at")

    def met(places: DataFrame, *columns: str) -> DataFrame:
        lines = places.join(needle.select(F.col("session_id").alias("needle_id"), F.col("ord").alias("o"), *columns), "needle_id").withColumn("place", F.col("at") + F.col("o"))
        there = hay.select(F.col("session_id").alias("container_id"), F.col("ord").alias("place"), *columns)
        both = lines.join(there, ["container_id", "place", *columns])
        whole = both.groupBy("needle_id", "container_id", "records", "at").agg(F.count("*").alias("matched"))
        return whole.where("matched = records").select("needle_id", "container_id", "records", "at")

    return met(met(at, "digest", "size"), "record").groupBy("needle_id", "container_id", "records").agg(F.min("at").alias("at"))


def containment(needles: DataFrame, haystacks: DataFrame | None = None) -> DataFrame:
    """(needle_id, container_id, records, at): sessions whose records stand contiguously in another, at the first place.

    The needle's rarest record is looked up in the other sessions, which fixes a diagonal; the needle is then
    matched along these diagonals alone. A boilerplate record in every session costs nothing, unless a needle has
    no other. Sessions without records are neither needle nor container.
    """
    needle = numbered(needles)
    hay = needle if haystacks is None else numbered(haystacks)
    places = hay.select(F.col("session_id").alias("container_id"), F.col("ord").alias("there"), F.col("n").alias("length"), "digest", "size")
    diagonals = _anchors(needle, hay).join(places, ["digest", "size"]).withColumn("at", F.col("there") - F.col("anchor"))
    return _along(diagonals, needle, hay)


def contained(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Of the ``pairs`` (needle_id, container_id) those where the container holds the needle; only their sessions are looked at."""
    asked = pairs.select("needle_id", "container_id").distinct()
    ids = asked.select(F.col("needle_id").alias("session_id")).unionByName(asked.select(F.col("container_id").alias("session_id"))).distinct()
    r = numbered(records.join(ids, "session_id", "left_semi"))
    places = r.select(F.col("session_id").alias("container_id"), F.col("ord").alias("there"), F.col("n").alias("length"), "digest", "size")
    diagonals = asked.join(_anchors(r, r), "needle_id").join(places, ["container_id", "digest", "size"]).withColumn("at", F.col("there") - F.col("anchor"))
    return _along(diagonals, r, r)


def pair_relation(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The class of each pair: identical, left or right contained, independent tails, shared records, unknown.

    A leading session_meta record belongs to the session, not to what was said in it, and is left out throughout.
    """
    records = without_meta(records)
    found = shared_prefix(pairs, records).join(shared_records(pairs, records), ["left_id", "right_id"])
    ways = pairs.select(F.col("left_id").alias("needle_id"), F.col("right_id").alias("container_id")).unionByName(pairs.select(F.col("right_id").alias("needle_id"), F.col("left_id").alias("container_id")))
    held = contained(ways, records).select("needle_id", "container_id", F.lit(True).alias("held"))
    found = found.join(held.select(F.col("needle_id").alias("left_id"), F.col("container_id").alias("right_id"), F.col("held").alias("l")), ["left_id", "right_id"], "left")
    found = found.join(held.select(F.col("needle_id").alias("right_id"), F.col("container_id").alias("left_id"), F.col("held").alias("r")), ["left_id", "right_id"], "left")
    left, right = F.coalesce("l", F.lit(False)), F.coalesce("r", F.lit(False))
    relation = F.when(left & right, "identical").when(left, "left_contained").when(right, "right_contained").when(F.col("prefix") > 0, "independent_tails").when(F.col("shared") > 0, "shared_records").otherwise("unknown")
    return found.select("left_id", "right_id", "prefix", "shared", relation.alias("relation"), (relation != "unknown").alias("verified_exact"))
