"""Timestamped branches: what a branch adds, the merged order, regressions, conversation kinds and hash chains.

Timestamps are nanoseconds since the epoch as long (``epoch_ns``), as Spark's own type ends at microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RFC3339 = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)$"


def epoch_ns(text: Column) -> Column:
    """RFC 3339 with up to nanoseconds as nanoseconds since the epoch; null if it isn't that."""
    whole = F.try_to_timestamp(F.concat(F.regexp_extract(text, RFC3339, 1), F.regexp_extract(text, RFC3339, 3)), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    nanos = F.rpad(F.regexp_extract(text, RFC3339, 2), 9, "0").cast("long")
    return F.when(text.rlike(RFC3339), F.unix_seconds(whole) * 1_000_000_000 + nanos)


def required_timestamp(text: Column, record: Column) -> Column:
    """The timestamp, or an error that names the record's number."""
    return F.coalesce(epoch_ns(text), F.raise_error(F.concat(F.lit("record "), record.cast("string"), F.lit(" has no timestamp"))).cast("long"))


def branch_only(base: DataFrame, branch: DataFrame) -> DataFrame:
    """The branch's records beyond those that base has: of each (digest, size), as many copies as base has are consumed.

    Both have session_id, seq, digest, size; the first copies by ``seq`` are the consumed ones.
    """
    have = base.groupBy("session_id", "digest", "size").agg(F.count("*").alias("have"))
    copy = F.row_number().over(W.partitionBy("session_id", "digest", "size").orderBy("seq"))
    numbered = branch.withColumn("copy", copy).join(have, ["session_id", "digest", "size"], "left")
    return numbered.where(F.col("copy") > F.coalesce("have", F.lit(0))).drop("copy", "have")


def analyze(base: DataFrame, branch: DataFrame) -> DataFrame:
    """(session_id, shared, base_only, added, output) of merging each session's branch into its base."""
    b = base.groupBy("session_id").agg(F.count("*").alias("nb"))
    r = branch.groupBy("session_id").agg(F.count("*").alias("nr"))
    a = branch_only(base, branch).groupBy("session_id").agg(F.count("*").alias("na"))
    x = b.join(r, "session_id", "full").join(a, "session_id", "left")
    nb, nr, na = (F.coalesce(c, F.lit(0)) for c in ("nb", "nr", "na"))
    return x.select("session_id", (nr - na).alias("shared"), (nb - nr + na).alias("base_only"), na.alias("added"), (nb + na).alias("output"))


def merge(base: DataFrame, branch: DataFrame) -> DataFrame:
    """Base with the branch's additions: ``ord`` is the place by time, then base first, then sequence."""
    both = base.withColumn("origin", F.lit(0)).unionByName(branch_only(base, branch).withColumn("origin", F.lit(1)))
    order = W.partitionBy("session_id").orderBy("epoch_ns", "origin", "seq")
    return both.withColumn("ord", (F.row_number().over(order) - 1).cast("long"))


def regressions(records: DataFrame, order: str = "seq") -> DataFrame:
    """(session_id, records, regressions, first_ns, last_ns): records earlier than the one just before; first and last by place."""
    before = F.lag("epoch_ns").over(W.partitionBy("session_id").orderBy(order))
    return records.withColumn("before", before).groupBy("session_id").agg(
        F.count("*").alias("records"), F.count_if(F.col("epoch_ns") < F.col("before")).alias("regressions"), F.min_by("epoch_ns", order).alias("first_ns"), F.max_by("epoch_ns", order).alias("last_ns")
    )


def conversation_kind(record: Column) -> Column:
    """user or assistant for messages and their events with a timestamp (null will do), as ``type:kind``; else ''."""
    at = lambda path: F.get_json_object(record, path)
    message = (at("$.type") == "response_item") & (at("$.payload.type") == "message") & at("$.payload.role").isin("user", "assistant")
    event = (at("$.type") == "event_msg") & at("$.payload.type").isin("user_message", "agent_message")
    stamped = F.array_contains(F.json_object_keys(record), "timestamp")
    kind = F.when(~F.coalesce(stamped, F.lit(False)), "").when(message, F.concat(F.lit("response_item:"), at("$.payload.role"))).when(event, F.concat(F.lit("event_msg:"), at("$.payload.type")))
    return F.coalesce(kind, F.lit(""))


def hash_chain(digests: Column) -> Column:
    """h = sha256(h || digest) over an array of hex digests in order, from 32 zero bytes; hex."""
    return F.aggregate(digests, F.lit("0" * 64), lambda h, d: F.sha2(F.unhex(F.concat(h, d)), 256))


def chains(records: DataFrame) -> DataFrame:
    """(session_id, chain) over each session's records; the chain is sequential by nature, its input one digest a record."""
    d = records.select("session_id", F.struct("rec_idx", F.sha2("record", 256).alias("d")).alias("r"))
    return d.groupBy("session_id").agg(hash_chain(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["d"])).alias("chain"))


def integrity(source: DataFrame, output: DataFrame) -> DataFrame:
    """(session_id, source_chain, output_chain, intact): whether all conversation records came through, in order.

    Both have (session_id, rec_idx, record) and are compared by the hash chains of their user and assistant records; a
    session without any has the empty chain. Other records may be mended or salvaged.
    """
    talk = lambda r: chains(r.where(conversation_kind(F.col("record")) != ""))
    ids = source.select("session_id").unionByName(output.select("session_id")).distinct()
    x = ids.join(talk(source).withColumnRenamed("chain", "s"), "session_id", "left").join(talk(output).withColumnRenamed("chain", "o"), "session_id", "left")
    none = F.lit("0" * 64)
    x = x.select("session_id", F.coalesce("s", none).alias("source_chain"), F.coalesce("o", none).alias("output_chain"))
    return x.withColumn("intact", F.col("source_chain") == F.col("output_chain"))


def verify_merge(merged: DataFrame, expected: DataFrame) -> DataFrame:
    """(session_id, ok): the merge has the number of records that ``analyze`` expects, in time order."""
    found = regressions(merged, "ord")
    joined = found.join(expected.select("session_id", "output"), "session_id", "full")
    return joined.select("session_id", (F.coalesce(F.col("records") == F.col("output"), F.lit(False)) & (F.coalesce("regressions", F.lit(1)) == 0)).alias("ok"))
