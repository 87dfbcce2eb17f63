"""Families of sessions over spawn edges, by frontier joins; every round is written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.sources.shared import stage


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that ``seeds`` (node) reach along (src, dst) edges, seeds included; cycles end by themselves."""
    seen = frontier = stage(seeds.select("node").distinct(), "seen")
    while True:
        near = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = stage(near.join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = stage(seen.unionByName(frontier), "seen")


def family(edges: DataFrame, catalog_ids: DataFrame, seed: int) -> DataFrame:
    """(node, in_catalog) of the undirected component of ``seed``; an unknown seed is an error."""
    both = edges.select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst")).unionByName(edges.select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst")))
    if catalog_ids.where(F.col("id") == seed).isEmpty():
        raise LookupError(f"unknown session {seed}")
    members = reachable(both, catalog_ids.where(F.col("id") == seed).select(F.col("id").alias("node")))
    there = catalog_ids.select(F.col("id").alias("node"), F.lit(True).alias("there")).distinct()
    return members.join(there, "node", "left").select("node", F.coalesce("there", F.lit(False)).alias("in_catalog"))


def family_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges between members (node) of a family, each once, in order; of the members, ``missing`` names those without a session."""
    inside = members.select("node")
    e = edges.select("parent_id", "child_id").distinct()
    e = e.join(inside.withColumnRenamed("node", "parent_id"), "parent_id", "left_semi").join(inside.withColumnRenamed("node", "child_id"), "child_id", "left_semi")
    return e.select("parent_id", "child_id").orderBy("parent_id", "child_id")


def missing(members: DataFrame) -> DataFrame:
    """(node) of the family's members that the catalog lacks, in order."""
    return members.where(~F.col("in_catalog")).select("node").orderBy("node")


def relation(edges: DataFrame, catalog_ids: DataFrame, seed: int) -> DataFrame:
    """(node, relation) of all catalog sessions to ``seed``: seed, ancestor, descendant, collateral or none."""
    start = catalog_ids.where(F.col("id") == seed).select(F.col("id").alias("node"))
    down = edges.select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"))
    up = edges.select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst"))
    marks = [(reachable(up, start), "a"), (reachable(down, start), "d"), (reachable(down.unionByName(up), start), "c")]
    out = catalog_ids.select(F.col("id").alias("node")).distinct()
    for nodes, mark in marks:
        out = out.join(nodes.withColumn(mark, F.lit(True)), "node", "left")
    kind = F.when(F.col("node") == seed, "seed").when(F.col("a"), "ancestor").when(F.col("d"), "descendant").when(F.col("c"), "collateral").otherwise("none")
    return out.select("node", kind.alias("relation"))
