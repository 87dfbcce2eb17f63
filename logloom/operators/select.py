"""Choosing sessions: selectors, search, archived filter, order, greedy byte cap, limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.folds import ordered_fold

SAFE_ID = r"^(?!\.{1,2}$)[^/\\\x00]+$"


def validate_selector(everything: bool, ids: Sequence[str], search: str) -> None:
    """Either all sessions, or some by id or search; not both and not neither."""
    some = bool(ids) or bool(search.strip())
    if everything == some:
        raise ValueError("choose either all sessions, or some by id or search")


def by_ids(catalog: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The named sessions; a name that the catalog lacks is an error (a query of the named rows only)."""
    found = catalog.where(F.col("id").isin(list(ids)))
    missing = sorted(set(ids) - {r["id"] for r in found.select("id").distinct().collect()})
    if missing:
        raise LookupError(f"unknown sessions: {', '.join(missing)}")
    return found


def search(catalog: DataFrame, text: str) -> DataFrame:
    """Sessions with the trimmed text in id, title or cwd, whatever the case; nothing to search for matches all."""
    wanted = F.lower(F.trim(F.lit(text)))
    return catalog.where(F.lit(not text.strip()) | F.contains(F.lower("id"), wanted) | F.contains(F.lower("title"), wanted) | F.contains(F.lower("cwd"), wanted))


def unarchived(catalog: DataFrame) -> DataFrame:
    return catalog.where(~F.col("archived"))


def missing_files(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """How many sessions have no file in ``listing`` (path, size)."""
    joined = catalog.join(listing.select(F.col("path").alias("rollout_path"), F.lit(True).alias("there")), "rollout_path", "left")
    return joined.agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count("there").alias("found"))


def largest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("size"), "id")


def greedy_within(catalog: DataFrame, cap: int, group: str | None = None) -> DataFrame:
    """Sessions taken largest first while they fit into ``cap`` bytes; one that doesn't fit is skipped, later ones may.

    The choice depends on all larger sessions, so it is a fold in the order of size, streamed over (size, id) of a
    group; ties go to the smaller id. Sessions larger than the cap can never fit and are dropped before.
    """
    key = [group] if group else []

    def fits(state: list, _id: str, size: int) -> bool:
        if state[0] + size > cap:
            return False
        state[0] += size
        return True

    fit = catalog.where(F.col("size") <= cap).select(*key, "id", "size").withColumn("negative", -F.col("size"))
    chosen = ordered_fold(fit, key, ["negative", "id"], ["id", "size"], lambda: [0], fits, "fits", "boolean").where("fits")
    same = F.lit(True)
    for c in [*key, "id"]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return catalog.alias("a").join(chosen.alias("b"), same, "left_semi")


def session(catalog: DataFrame, session_id: str) -> DataFrame:
    """The one session of that id, else an error."""
    return by_ids(catalog, [session_id]).limit(1)
