"""Connected components over an edge table, as joins; nothing is gathered on the driver but a count per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.staging import stage


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of an undirected edge table; the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, until
    none changes: the number of rounds grows with the logarithm of the longest path, not with its length.
    An empty edge table gives no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = stage(lower.join(jump, "mid", "left").select("node", "was", F.least(F.col("mid"), F.coalesce("far", "mid")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("was <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
