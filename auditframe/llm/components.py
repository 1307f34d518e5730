"""Connected components of a table of links, by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.base import stored


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node in ``links`` (a, b: longs).

    Each round points every node to its smallest neighbour, follows the pointers twice, and relabels the
    links; links inside a component vanish. The minima are pre-aggregated per task, all tables are rows, and every
    round starts from stored tables, so a node with a third of all links is no hot group and a lost
    executor costs a round at most.
    """
    edges = stored(links.where("a <> b").select("a", "b").distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        parent = near
        for _ in range(2):
            parent = parent.join(near.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        parent = stored(parent)
        labels = labels.join(parent.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        one = edges.join(parent, "a").select(F.col("p").alias("a"), "b")
        two = one.join(parent.select(F.col("a").alias("b"), "p"), "b").select("a", F.col("p").alias("b"))
        edges = stored(two.where("a <> b").distinct())
    return stored(labels)
