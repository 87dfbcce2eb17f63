"""Analytics of the object store's files: classes, inventory, budget, retention, reclaimable bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How names of unowned temporary files begin, after their dot; or they contain .tmp.
TEMPORARY = ("generation-", "compact-", "object-", "manifest-", "materialize-", "backing-", "CURRENT-")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def is_temporary(path: Column) -> Column:
    name = base_name(path)
    return name.startswith(".") & (name.contains(".tmp") | name.rlike(r"^\.(" + "|".join(TEMPORARY) + ")"))


def within(folder: str, path: Column) -> Column:
    """Lexically in a folder or that folder itself; both paths clean."""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def file_class(store: str, path: Column, owner: Column, current_pack: str) -> Column:
    """A file's storage class; ``owner`` is backing, delta, journal or null, for files that session states name.

    The first rule that fits decides: owners, then folders, then temporary names, objects and generations.
    """
    root = store.rstrip("/")
    pack = F.regexp_extract(F.substring(path, len(root) + 1, 1 << 20), r"^/packs/generations/([^/]+)/", 1)
    return (
        F.when(owner == "backing", "writable_backings").when(owner == "delta", "active_deltas").when(owner == "journal", "journal_recovery")
        .when(within(f"{root}/fs/retired", path), "retirement_state").when(within(f"{root}/fs/snapshots", path), "retained_snapshots")
        .when(within(f"{root}/fs/fallbacks", path) & base_name(path).isin("fallback-current.jsonl", "quarantine-current.jsonl"), "current_fallbacks")
        .when(is_temporary(path), "unowned_temporary").when(within(f"{root}/objects", path) & path.endswith(".zst"), "unique_loose_objects")
        .when(within(root, path) & (pack == current_pack) & (pack != ""), "packs").when(within(root, path) & (pack != ""), "old_generations")
        .when(within(f"{root}/manifests/generations", path), "old_generations").when(path.rlike(r"/fs/sessions/[^/]+/generations/"), "old_generations")
        .otherwise("metadata")
    )


def inventory(files: DataFrame) -> DataFrame:
    """(class, files, apparent_bytes, physical_bytes, aliases): physical bytes once per inode, for its first path."""
    first = F.row_number().over(W.partitionBy("inode").orderBy("path")) == 1
    f = files.withColumn("first", first)
    return f.groupBy("class").agg(
        F.count("*").alias("files"), F.sum("size").alias("apparent_bytes"), F.coalesce(F.sum(F.when(F.col("first"), F.col("size"))), F.lit(0)).alias("physical_bytes"), F.count_if(~F.col("first")).alias("aliases")
    )


def logical_bytes(states: DataFrame, manifests: DataFrame) -> DataFrame:
    """(logical_bytes): of each managed session its backing, else base and delta; of other manifests their source."""
    managed = states.select("session_id", F.coalesce(F.col("backing_bytes"), F.col("base_bytes") + F.col("delta_bytes")).alias("n"))
    others = manifests.join(states, "session_id", "left_anti").select("session_id", F.col("source_bytes").alias("n"))
    return managed.unionByName(others).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("logical_bytes"))


def check_budget(requests: DataFrame, max_physical: int = 0, max_temporary: int = 0, reserve: int = 0) -> DataFrame:
    """Projected peak and final bytes of each request, the space left at the peak, and the reasons against it.

    Limits of 0 are none, but the reserve always holds. Negative counts, or an overlap above what it is part of, are errors.
    """
    counts = ["current_bytes", "persistent_bytes", "temporary_bytes", "overlap_bytes", "reclaimable_bytes", "available_bytes"]
    wrong = F.least(*counts) < 0
    wrong = wrong | (F.col("overlap_bytes") > F.col("temporary_bytes")) | (F.col("overlap_bytes") > F.col("persistent_bytes"))
    r = requests.withColumn("current_bytes", F.when(wrong, F.raise_error(F.lit("impossible byte counts")).cast("long")).otherwise(F.col("current_bytes")))
    more = F.col("persistent_bytes") + F.col("temporary_bytes") - F.col("overlap_bytes")
    before = F.col("current_bytes") + F.col("persistent_bytes")
    r = r.withColumns({"peak_bytes": F.col("current_bytes") + more, "final_bytes": before - F.least("reclaimable_bytes", before), "free_after_peak": F.col("available_bytes") - more})
    reasons = [
        F.when(F.lit(max_physical > 0) & (F.col("peak_bytes") > max_physical), "physical_budget"),
        F.when(F.lit(max_temporary > 0) & (F.col("temporary_bytes") > max_temporary), "temporary_budget"),
        F.when(F.col("free_after_peak") < reserve, "free_space_reserve"),
    ]
    return r.withColumn("rejections", F.array_compact(F.array(*reasons))).withColumn("allowed", F.size("rejections") == 0)


def reclaimed(before: Column, after: Column) -> Column:
    return F.greatest(before - after, F.lit(0))


def sequence_of(name: Column) -> Column:
    """The sequence number in a generation's name, null where it has none."""
    digits = F.regexp_extract(name, r"(\d+)(?:\.[A-Za-z]+)?$", 1)
    return F.when(digits != "", digits.cast("long"))


def _newest(group: list[str]) -> W:
    return W.partitionBy(*group).orderBy(F.col("sequence").isNull(), F.desc("sequence"), F.desc("mtime"), F.desc("name"))


def pack_candidates(generations: DataFrame, keep: int = 2) -> DataFrame:
    """Pack generations to remove: not the current, not leased, and beyond the ``keep`` - 1 newest of the others."""
    others = generations.where(~F.col("current") & ~F.col("leased"))
    return others.withColumn("place", F.row_number().over(_newest(["store"]))).where(F.col("place") > max(0, keep - 1)).drop("place")


def manifest_candidates(generations: DataFrame, keep: int = 2) -> DataFrame:
    """Manifest generations to remove, per session: those after the current sequence, and the older beyond ``keep`` - 1.

    Sessions with one file or none keep it.
    """
    several = generations.withColumn("n", F.count("*").over(W.partitionBy("session_id"))).where("n > 1").drop("n")
    future = several.where(F.col("sequence") > F.col("current_sequence"))
    older = several.where((F.col("sequence") < F.col("current_sequence")) | F.col("sequence").isNull())
    older = older.withColumn("place", F.row_number().over(_newest(["session_id"]))).where(F.col("place") > max(0, keep - 1)).drop("place")
    return future.unionByName(older)


def session_candidates(files: DataFrame, current: DataFrame, journal: DataFrame, leases: DataFrame) -> DataFrame:
    """Session generation files that no state, journal or live lease holds (current and journal by path, leases by session)."""
    return files.join(current.select("path"), "path", "left_anti").join(journal.select("path"), "path", "left_anti").join(leases.select("session_id"), "session_id", "left_anti")


def retired_candidates(retired: DataFrame, keep: int = 1) -> DataFrame:
    """Retired states beyond the ``keep`` newest of each session."""
    return retired.withColumn("place", F.row_number().over(_newest(["session_id"]))).where(F.col("place") > keep).drop("place")


def temporary_candidates(files: DataFrame, now: int, grace: int = 3600) -> DataFrame:
    """Temporary files untouched for ``grace`` seconds."""
    return files.where(is_temporary(F.col("path")) & (F.col("mtime") <= now - grace))


def reclaimable(candidates: DataFrame) -> DataFrame:
    """(path, reclaimable_bytes): an inode's bytes count if all its links are candidates, for the first of them by path."""
    per = candidates.groupBy("inode").agg(F.count("*").alias("n"), F.max("links").alias("links"), F.min("path").alias("first"), F.max("size").alias("size"))
    freed = per.where("n = links").select("inode", "first", "size")
    joined = candidates.select("inode", "path").join(freed, "inode", "left")
    return joined.select("path", F.when(F.col("path") == F.col("first"), F.col("size")).otherwise(0).cast("long").alias("reclaimable_bytes"))
