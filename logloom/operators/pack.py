"""Packs of content-addressed objects: distinct references, blocks, rotation, validation, and range reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.operators.folds import ordered_fold
from logloom.sources.shared import scratch, stage

BLOCK_BYTES, PACK_BYTES, RAW_BYTES = 256 << 10, 512 << 20, 16 << 10


def references(manifest_parts: DataFrame) -> DataFrame:
    """(sha256, raw_bytes, refs, conflict): distinct objects; a digest with different sizes is a conflict."""
    r = manifest_parts.groupBy("sha256").agg(F.min("raw_bytes").alias("raw_bytes"), F.count("*").alias("refs"), F.max("raw_bytes").alias("most"))
    return r.select("sha256", "raw_bytes", "refs", (F.col("raw_bytes") != F.col("most")).alias("conflict"))


def blocks(objects: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(sha256, block_idx, raw_offset, raw_bytes, block_sha256, bytes): each object in blocks of one size, the last shorter."""
    n = F.octet_length("bytes")
    cut = objects.where(n > 0).select("sha256", "bytes", F.explode(F.sequence(F.lit(0), n - 1, F.lit(block_bytes))).alias("raw_offset"))
    piece = F.substring("bytes", F.col("raw_offset") + 1, F.lit(block_bytes))
    return cut.select("sha256", F.expr(f"raw_offset div {block_bytes}").alias("block_idx"), F.col("raw_offset").cast("long").alias("raw_offset"), F.octet_length(piece).cast("long").alias("raw_bytes"), F.sha2(piece, 256).alias("block_sha256"), piece.alias("bytes"))


def encoding(raw: Column, compressed: Column, raw_limit: int = RAW_BYTES) -> Column:
    """raw if compression doesn't pay: not smaller at all, or a small block not below half."""
    return F.when((compressed >= raw) | ((raw <= raw_limit) & (compressed * 2 >= raw)), "raw").otherwise("zstd")


def rotate(block_sizes: DataFrame, limit: int = PACK_BYTES, shard: str | None = None) -> DataFrame:
    """(…, pack, pack_offset) for (sha256, block_idx, stored_bytes) by next fit: a block that no longer fits opens a pack.

    One larger than the limit has a pack of its own. Next fit is sequential: a fold in the order of (digest, index),
    streamed over the blocks of one ``shard`` (a column; packs are numbered within it), so many shards pack side by side.
    """
    key = [shard] if shard else []

    def place(state: list, size: int) -> str:
        if state[1] and state[1] + size > limit:
            state[:] = [state[0] + 1, 0]
        at = state[1]
        state[1] += size
        return f"{state[0]}:{at}"

    placed = ordered_fold(block_sizes.select(*key, "sha256", "block_idx", "stored_bytes"), key, ["sha256", "block_idx"], ["stored_bytes"], lambda: [0, 0], place, "place", "string")
    at = F.split("place", ":")
    return placed.select(*key, "sha256", "block_idx", "stored_bytes", at[0].cast("long").alias("pack"), at[1].cast("long").alias("pack_offset"))


def index_issues(index: DataFrame) -> DataFrame:
    """(sha256, issue) over (sha256, block_idx, raw_offset, raw_bytes, object_bytes): gaps between blocks, wrong totals."""
    w = W.partitionBy("sha256").orderBy("block_idx")
    end = F.col("raw_offset") + F.col("raw_bytes")
    seen = index.withColumn("expected", F.coalesce(F.lag(end).over(w), F.lit(0)))
    per = seen.groupBy("sha256").agg(F.count_if(F.col("expected") != F.col("raw_offset")).alias("gaps"), F.sum("raw_bytes").alias("total"), F.max("object_bytes").alias("object_bytes"))
    issue = F.when(F.col("gaps") > 0, "gap").when(F.col("total") != F.col("object_bytes"), "wrong_total")
    return per.select("sha256", issue.alias("issue")).where("issue IS NOT NULL")


def view(parts: DataFrame) -> DataFrame:
    """Parts with ``view_start`` and ``view_end`` in their session's bytes; a part without bytes is an error."""
    size = F.when(F.col("raw_bytes") > 0, F.col("raw_bytes")).otherwise(F.raise_error(F.lit("a part has no bytes")).cast("long"))
    end = F.sum(size).over(W.partitionBy("session_id").orderBy("part_idx"))
    return parts.withColumn("view_end", end).withColumn("view_start", F.col("view_end") - F.col("raw_bytes"))


def read_ranges(ranges: DataFrame, viewed: DataFrame, objects: DataFrame) -> DataFrame:
    """(session_id, lo, hi, data) for requested ranges [lo, hi) of sessions: only the parts they touch are joined.

    Each distinct object is joined once per range and part; ranges past the end give what there is.
    """
    v = viewed.select("session_id", "part_idx", "sha256", "view_start", "view_end")
    hit = ranges.join(v, "session_id").where("view_start < hi AND view_end > lo")
    pieces = hit.join(objects.select("sha256", "bytes"), "sha256")
    begin = F.greatest(F.col("lo") - F.col("view_start"), F.lit(0))
    size = F.least(F.col("hi"), F.col("view_end")) - F.greatest(F.col("lo"), F.col("view_start"))
    cut = pieces.select("session_id", "lo", "hi", "part_idx", F.substring("bytes", (begin + 1).cast("int"), size.cast("int")).alias("piece"))
    return cut.groupBy("session_id", "lo", "hi").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY part_idx)").alias("data"))


def cached_blocks(reads: DataFrame, budget: int, largest: int, cache: str) -> DataFrame:
    """(cache, block, size) that a least-recently-used cache of ``budget`` bytes holds after ``reads`` (at, block, size).

    Blocks above ``largest`` bytes are never cached. What it holds are the blocks last read, as far as the budget reaches:
    the newest whose sizes add up to no more. Spark keeps hot blocks by ``persist``; this tells which those would be.
    """
    last = reads.where(F.col("size") <= largest).groupBy(cache, "block").agg(F.max("at").alias("at"), F.max("size").alias("size"))
    used = F.sum("size").over(W.partitionBy(cache).orderBy(F.desc("at"), "block").rowsBetween(W.unboundedPreceding, 0))
    return last.withColumn("used", used).where(F.col("used") <= budget).select(cache, "block", "size")


def nearest_ranks(rows: DataFrame, group: str, value: str, percents: Sequence[int]) -> DataFrame:
    """(group, p50, …): of each group the value at rank ceil(n * percent / 100) of its values that aren't null.

    Equal values are counted before anything is sorted. The counts are range-sorted by group and value; ranges' totals then
    say in which range a rank lies, so a large group is spread over many tasks.
    """
    with scratch(rows.sparkSession):
        counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
        ranged = counts.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, value).withColumn("range", F.spark_partition_id())
        ranged = stage(ranged, "ranks")
        per = ranged.groupBy(group, "range").agg(F.sum("n").alias("m"))
        along = W.partitionBy(group).orderBy("range")
        per = per.select(group, "range", "m", (F.sum("m").over(along) - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy(group)).alias("total"))
        wanted = per.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("rank", F.expr("(total * percent + 99) div 100"))
        wanted = wanted.where("before < rank AND rank <= before + m").select(F.col(group).alias("g"), F.col("range").alias("r"), "percent", (F.col("rank") - F.col("before")).alias("rank"))
        near = ranged.join(F.broadcast(wanted.select("r").distinct()), ranged["range"] == F.col("r"), "left_semi")  # as many as percents and groups
        near = near.withColumn("upto", F.sum("n").over(W.partitionBy(group, "range").orderBy(value)))
        hit = near.join(wanted, near[group].eqNullSafe(F.col("g")) & (F.col("range") == F.col("r"))).where("upto >= rank AND upto - n < rank")
        found = hit.groupBy(group).agg(*[F.max(F.when(F.col("percent") == p, F.col(value))).alias(f"p{p}") for p in percents])
        return stage(found, "percentiles", keep=True)


def visible(states: DataFrame) -> DataFrame:
    """What a session shows: its backing's bytes and size if there is one, else base followed by delta."""
    both = F.concat(F.coalesce("base", F.lit(b"")), F.coalesce("delta", F.lit(b"")))
    data = F.coalesce("backing", both)
    return states.select("session_id", data.alias("data"), F.octet_length(data).cast("long").alias("size"))


def read_visible(ranges: DataFrame, states: DataFrame) -> DataFrame:
    """(session_id, lo, hi, data) for ranges [lo, hi) of what sessions show: of a backing, else of base and delta together.

    The base and the delta are cut by themselves, so a range in one of them doesn't touch the other; ranges past the end
    give what there is.
    """
    x = ranges.join(states, "session_id")
    size = F.coalesce(F.octet_length("base"), F.lit(0))

    def cut(data: Column, lo: Column, hi: Column) -> Column:
        lo, hi = F.greatest(lo, F.lit(0)), F.greatest(hi, F.lit(0))
        return F.when(hi > lo, F.substring(data, (lo + 1).cast("int"), (hi - lo).cast("int"))).otherwise(F.lit(b""))

    lo, hi = F.col("lo"), F.col("hi")
    both = F.concat(cut(F.coalesce("base", F.lit(b"")), lo, F.least(hi, size)), cut(F.coalesce("delta", F.lit(b"")), lo - size, hi - size))
    return x.select("session_id", "lo", "hi", F.when(F.col("backing").isNotNull(), cut(F.col("backing"), lo, hi)).otherwise(both).alias("data"))


def shadow_ranges(sizes: DataFrame, n: int = 16, most: int = 4096, seed: int = 42) -> DataFrame:
    """(session_id, lo, hi): the whole of each session (session_id, size), and ``n`` ranges that the seed draws."""
    whole = sizes.select("session_id", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))
    drawn = sizes.where("size > 0").select("session_id", "size", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    drawn = drawn.withColumn("lo", F.pmod(F.xxhash64(F.lit(seed), "session_id", "i"), F.col("size")))
    length = F.pmod(F.xxhash64(F.lit(seed + 1), "session_id", "i"), F.lit(most)) + 1
    return whole.unionByName(drawn.select("session_id", "lo", F.least(F.col("lo") + length, F.col("size")).alias("hi")))


def shadow_compare(ranges: DataFrame, read: DataFrame, native: DataFrame) -> DataFrame:
    """(session_id, lo, hi) of the ranges whose bytes read virtually differ from the native file's (session_id, data).

    A range that wasn't read is read as no bytes.
    """
    wanted = F.substring("data", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    asked = ranges.join(native, "session_id").select("session_id", "lo", "hi", F.sha2(wanted, 256).alias("wanted"))
    got = read.select("session_id", "lo", "hi", F.sha2("data", 256).alias("got")).distinct()
    both = asked.distinct().join(got, ["session_id", "lo", "hi"], "left")
    return both.where(F.col("wanted") != F.coalesce("got", F.sha2(F.lit(b""), 256))).select("session_id", "lo", "hi")


def packed_objects(packed_blocks: DataFrame, **also: Column) -> DataFrame:
    """(sha256, raw_bytes, bytes) of the objects put together from their blocks, which are verified one by one.

    A block whose bytes don't have its digest makes its object null, for ``pack_doctor`` to report. ``also``: further
    aggregates of an object's blocks.
    """
    sound = F.sha2("bytes", 256) == F.col("block_sha256")
    per = packed_blocks.groupBy("sha256").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY block_idx)").alias("bytes"), F.bool_and(sound).alias("sound"), *[c.alias(name) for name, c in also.items()])
    return per.select("sha256", F.octet_length("bytes").cast("long").alias("raw_bytes"), F.when(F.col("sound"), F.col("bytes")).alias("bytes"), *also)


def pack_doctor(packed_blocks: DataFrame, manifest_parts: DataFrame) -> DataFrame:
    """(subject, id, issue): every object and every manifest checked through the packs alone.

    Objects: ``gap``, ``damaged_block`` or ``wrong_digest`` (or another size than the index gives). Manifests' parts:
    ``missing_object`` or ``size_mismatch``, one row per session and issue. Sizes of parts are compared with the index,
    since damaged bytes may be of any size.
    """
    order = W.partitionBy("sha256").orderBy("block_idx")
    gap = F.coalesce(F.lag(F.col("raw_offset") + F.col("raw_bytes")).over(order), F.lit(0)) != F.col("raw_offset")
    with scratch(packed_blocks.sparkSession):
        o = packed_objects(packed_blocks.withColumn("gap", gap), gap=F.bool_or("gap"), indexed=F.sum("raw_bytes"))
        other = (F.sha2("bytes", 256) != F.col("sha256")) | (F.col("raw_bytes") != F.col("indexed"))
        issue = F.when(F.col("gap"), "gap").when(F.col("bytes").isNull(), "damaged_block").when(other, "wrong_digest")
        o = stage(o.select("sha256", "indexed", issue.alias("issue")), "doctored")  # the bytes are read once, for objects and manifests
        wrong = o.select(F.lit("object").alias("subject"), F.col("sha256").alias("id"), "issue").where("issue IS NOT NULL")
        p = manifest_parts.join(o.select("sha256", "indexed"), "sha256", "left")
        issue = F.when(F.col("indexed").isNull(), "missing_object").when(F.col("indexed") != F.col("raw_bytes"), "size_mismatch")
        bad = p.select(F.lit("manifest").alias("subject"), F.col("session_id").cast("string").alias("id"), issue.alias("issue")).where("issue IS NOT NULL").distinct()
        return stage(wrong.unionByName(bad), "issues", keep=True)


def retirable(loose: DataFrame, packed: DataFrame, pack_issues: int, loose_issues: int) -> DataFrame:
    """Loose objects that packs hold too, if neither doctor has an issue; else none."""
    found = loose.join(packed.select("sha256"), "sha256", "left_semi")
    return found if not pack_issues and not loose_issues else found.limit(0)
