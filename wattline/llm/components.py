"""Connected components of a table of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import hot_keys, kept, salted, sized, spread


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for every end of the links (a, b); component is the smallest node reachable.

    Each round takes the least label among a node's neighbours and then the label of that label
    (pointer jumping), so the rounds grow with the logarithm of the longest path. Tables live in the
    shared folder. The links of a hub are dealt out by the node at their other end; of the labels only those
    that are no root any more are looked up, so that all nodes of a large component don't meet at its root.
    No links give no rows.
    """
    ends = links.where("a <> b").select("a", "b")
    ends = kept(spark, ends.union(ends.select(F.col("b"), F.col("a"))).distinct(), "links")
    degrees = ends.groupBy("b").agg(F.count("*").alias("n"))
    hubs = hot_keys(spark, degrees, "b")
    ends = kept(spark, salted(ends, "b", hubs, ["a"]), "links")
    labels = kept(
        spark, ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels"
    )
    while True:
        near = (
            ends.join(spread(labels.withColumnRenamed("node", "b"), "b", hubs), ["b", "_salt"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        low = labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("low")
        )
        low = kept(spark, low, "low")
        jump = low.select("low").distinct().join(labels.select(F.col("node").alias("low"), F.col("component").alias("jump")), "low")
        step = low.join(sized(jump.where("jump < low")), "low", "left")
        step = kept(spark, step.select("node", F.coalesce("jump", "low").alias("component"), "was"), "labels")
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels
