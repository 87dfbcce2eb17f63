"""What may go from a store: all candidates together, the guard before work that needs space, and proofs before removal."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators import store


class Retention(NamedTuple):
    temporary_grace: int = 3600
    packs: int = 2
    manifests: int = 2
    retired: int = 1


def garbage(files: DataFrame, packs: DataFrame, manifests: DataFrame, sessions: DataFrame, retired: DataFrame, current: DataFrame, journal: DataFrame, leases: DataFrame, now: int, keep: Retention = Retention()) -> DataFrame:
    """(kind, path, reclaimable_bytes): every candidate of every kind, each path once, for the first kind that names it.

    ``packs``, ``manifests`` and ``retired`` are generations with the paths of their files, ``sessions`` session
    generation files, ``files`` the store's listing (path, inode, links, size, mtime). Bytes count as ``reclaimable`` has
    it, over all kinds together: an inode that two kinds share is freed if both go.
    """
    kinds = [
        (0, "pack", store.pack_candidates(packs, keep.packs)), (1, "manifest", store.manifest_candidates(manifests, keep.manifests)),
        (2, "session", store.session_candidates(sessions, current, journal, leases)), (3, "retired", store.retired_candidates(retired, keep.retired)),
        (4, "temporary", store.temporary_candidates(files, now, keep.temporary_grace)),
    ]
    named = None
    for place, kind, rows in kinds:
        some = rows.select("path", F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind")).alias("k"))
        named = some if named is None else named.unionByName(some)
    once = named.groupBy("path").agg(F.min("k")["kind"].alias("kind"))
    listed = once.join(files.select("path", "inode", "links", "size"), "path")
    return listed.select("kind", "path").join(store.reclaimable(listed), "path").select("kind", "path", "reclaimable_bytes")


def guard(files: DataFrame, free: int, persistent: int, temporary: int, overlap: int = 0, reclaimable: int = 0, max_physical: int = 0, max_temporary: int = 0, reserve: int = 0) -> DataFrame:
    """One row: whether work may begin that adds ``persistent`` and needs ``temporary`` bytes, and what speaks against it.

    What the store holds now is the physical bytes of its inventory; an empty store holds none.
    """
    held = store.inventory(files).agg(F.coalesce(F.sum("physical_bytes"), F.lit(0)).alias("current_bytes"))
    asked = {"persistent_bytes": persistent, "temporary_bytes": temporary, "overlap_bytes": overlap, "reclaimable_bytes": reclaimable, "available_bytes": free}
    return store.check_budget(held.withColumns({c: F.lit(v).cast("long") for c, v in asked.items()}), max_physical, max_temporary, reserve)


def removal_proof(catalog: DataFrame, held: DataFrame, manifest_issues: DataFrame, verified: DataFrame, source: DataFrame) -> DataFrame:
    """(session_id, container_id, archived, healthy, unfolded, unchanged, proven) of each session that another contains.

    ``held`` is ``sequence.containment``, ``manifest_issues`` the doctor's rows, ``verified`` what ``fold.verify`` says
    of the session, and ``source`` its (session_id, size, known_size). Only what all agree on is proven: archived, a
    manifest without issue, bytes that unfold to the source, and a source as it was when it was folded. A report; nothing
    is removed. A session that is missing from one of the tables fails that proof.
    """
    c = catalog.select(F.col("id").alias("session_id"), "archived")
    bad = manifest_issues.select("session_id", F.lit(False).alias("healthy")).distinct()
    x = held.select(F.col("needle_id").alias("session_id"), "container_id").join(c, "session_id", "left").join(bad, "session_id", "left")
    x = x.join(verified.select("session_id", F.col("verified").alias("unfolded")), "session_id", "left")
    x = x.join(source.select("session_id", F.col("size").eqNullSafe(F.col("known_size")).alias("unchanged")), "session_id", "left")
    no = F.lit(False)
    x = x.select("session_id", "container_id", F.coalesce("archived", no).alias("archived"), F.coalesce("healthy", F.lit(True)).alias("healthy"), F.coalesce("unfolded", no).alias("unfolded"), F.coalesce("unchanged", no).alias("unchanged"))
    return x.withColumn("proven", F.col("archived") & F.col("healthy") & F.col("unfolded") & F.col("unchanged"))
