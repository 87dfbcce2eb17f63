"""Which sessions to enroll next: gates and stability per session, then a byte budget and a batch limit in order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.fold import storage_estimate
from logloom.operators.folds import ordered_fold
from logloom.operators.select import SAFE_ID


class Policy(NamedTuple):
    now: int  # seconds, like all times here
    stable_for: int = 3600
    batch: int = 1
    archived_only: bool = False


class Gates(NamedTuple):
    mount_healthy: bool = True
    canonical_namespace: bool = True
    namespace_active: bool = True
    namespace_ready: bool = True
    doctor_healthy: bool = True
    enrollment_allowed: bool = True


class Budget(NamedTuple):
    current: int = 0
    available: int = 1 << 62
    max_physical: int = 0
    max_temporary: int = 0
    reserve: int = 0


def enrollment_bytes(raw: Column) -> Column:
    """Three copies of the storage estimate."""
    return F.lit(3) * storage_estimate(raw)


def observed(sessions: DataFrame, previous: DataFrame, policy: Policy) -> DataFrame:
    """``sessions`` (id, rollout_path, size, mtime) with ``seen``, ``unchanged`` and ``stable_since`` from the last observation."""
    p = previous.select(F.col("session_id").alias("id"), F.col("path").alias("p_path"), F.col("size").alias("p_size"), F.col("mtime").alias("p_mtime"), F.col("stable_since").alias("p_since"))
    x = sessions.join(p, "id", "left")
    same = F.col("p_path").eqNullSafe(F.col("rollout_path")) & F.col("p_size").eqNullSafe(F.col("size")) & F.col("p_mtime").eqNullSafe(F.col("mtime"))
    x = x.withColumn("seen", F.col("p_path").isNotNull()).withColumn("unchanged", F.col("seen") & same)
    return x.withColumn("stable_since", F.when(F.col("unchanged"), F.col("p_since")).otherwise(F.lit(policy.now))).drop("p_path", "p_size", "p_mtime", "p_since")


def decisions(sessions: DataFrame, previous: DataFrame, managed: DataFrame, writers: DataFrame, policy: Policy, gates: Gates = Gates(), budget: Budget | None = Budget()) -> DataFrame:
    """(id, place, reasons, selected, stable_since) of every session, oldest update first.

    Managed sessions, unsafe paths and closed gates end with their one reason. Other reasons add up. Sessions without any
    compete in order: each must fit the budget on top of those selected before, then the batch limit.
    The competition is a fold streamed over (update, id, bytes) of the sessions that got that far, not over the catalog.
    """
    x = observed(sessions, previous, policy)
    x = x.join(managed.select(F.col("session_id").alias("id"), F.lit(True).alias("is_managed")).distinct(), "id", "left")
    x = x.join(writers.select(F.col("session_id").alias("id"), F.lit(True).alias("is_written")).distinct(), "id", "left")
    early = F.when(F.col("is_managed"), "already_managed").when(~F.col("id").rlike(SAFE_ID) | ~F.col("rollout_path").startswith("/"), "invalid_path")
    for open_, reason in ((gates.mount_healthy, "mount_unhealthy"), (gates.canonical_namespace, "namespace_disabled"), (gates.namespace_active, "namespace_inactive"), (gates.namespace_ready, "mount_warming")):
        early = early.when(F.lit(not open_), reason)
    early = early.when(F.col("size").isNull(), "invalid_path")
    stability = (
        F.when(~F.col("seen"), "stability_pending").when(~F.col("unchanged"), "file_changed")
        .when((policy.now - F.col("stable_since") < policy.stable_for) | (policy.now - F.col("mtime") < policy.stable_for), "stability_pending")
    )
    late = F.array_compact(F.array(
        F.when(F.lit(policy.archived_only) & ~F.col("archived"), "not_archived"), F.when(F.lit(not gates.doctor_healthy), "doctor_unhealthy"),
        F.when(F.lit(not gates.enrollment_allowed), "promotion_stage"), F.when(F.col("is_written"), "writer_active"), stability,
    ))
    x = x.withColumn("early", early).withColumn("reasons", F.when(F.col("early").isNotNull(), F.array("early")).otherwise(late))

    ready = x.where(F.size("reasons") == 0)
    limits, current = budget, (budget or Budget()).current

    def compete(state: list, size: int, more: int) -> str | None:
        used = state[0] + more
        fits = limits is not None
        if limits is not None:
            fits = (limits.max_physical <= 0 or current + used + size <= limits.max_physical) and (limits.max_temporary <= 0 or size <= limits.max_temporary)
            fits = fits and limits.available - used - size >= limits.reserve
        if not fits:
            return "insufficient_budget"
        if state[1] >= max(1, policy.batch):
            return "batch_limit"
        state[:] = [used, state[1] + 1]
        return None

    queued = ready.select("updated_at", "id", "size", enrollment_bytes(F.col("size")).alias("more"))
    settled = ordered_fold(queued, [], ["updated_at", "id"], ["size", "more"], lambda: [0, 0], compete, "reason", "string").select("id", "reason", F.lit(True).alias("competed"))
    x = x.join(settled, "id", "left")
    reasons = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(F.col("reasons"))
    return x.select("id", "updated_at", reasons.alias("reasons"), (F.coalesce("competed", F.lit(False)) & F.col("reason").isNull()).alias("selected"), F.when(F.col("early").isNull(), F.col("stable_since")).alias("stable_since"))


def apply_plan(selected: DataFrame, current: DataFrame, managed: DataFrame, limit: int) -> DataFrame:
    """(id, outcome) of the first ``limit`` selected: the limit comes before managed and changed sessions are skipped."""
    few = selected.orderBy("updated_at", "id").limit(limit)
    now = current.select("id", F.col("size").alias("now_size"), F.col("mtime").alias("now_mtime"))
    x = few.join(now, "id", "left").join(managed.select(F.col("session_id").alias("id"), F.lit(True).alias("m")).distinct(), "id", "left")
    same = F.col("size").eqNullSafe(F.col("now_size")) & F.col("mtime").eqNullSafe(F.col("now_mtime"))
    return x.select("id", F.when(F.col("m"), "skipped_managed").when(~same, "skipped_changed").otherwise("apply").alias("outcome"))
