"""Connected components of an edge table, without collecting anything."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable, from edges (a, b). Every node of an edge appears once.

    Each round gives a node the least label among its own and its neighbours' and then jumps: the label's own label.
    Labels only fall and chains halve, so the rounds are about the logarithm of the longest path. Minima combine
    on the map side, so a node with many edges costs one row a task.
    """
    both = edges.select("a", "b").where("a <> b")
    both = stored(both.union(both.select(F.col("b"), F.col("a"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        low = stored(low)
        jump = low.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        new = stored(low.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("to", "comp")).alias("comp")))
        if new.where("old <> comp").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
