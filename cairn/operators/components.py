"""Connected components of an undirected graph, by minimum labels and pointer jumping.

Every round joins plain tables that were written before, so that a hub with a
third of all links is a skewed join Spark can split; sums by node are combined
before they are shuffled. Rounds grow with the logarithm of a component's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.store import drop, settle


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component: the smallest node reachable; only nodes with a link to another node are returned.

    Links that are null on a side or join a node to itself count for nothing; repeated links and both directions are one link.
    """
    one = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    both = settle(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        nearer = settle(labels.join(near, labels.node == near.a).select("node", F.least("component", "m").alias("via"), F.col("component").alias("old")))
        if nearer.where("via <> old").isEmpty():
            drop(both, nearer)
            return labels
        ahead = nearer.select(F.col("node").alias("via"), F.col("via").alias("next"))
        further = settle(nearer.join(ahead, "via").select("node", F.col("next").alias("component")))
        drop(labels, nearer)
        labels = further
