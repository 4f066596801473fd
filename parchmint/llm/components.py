"""Connected components of an edge table by minimum labels and pointer jumping, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import materialize


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: each node keeps its smallest smaller neighbour, which takes over the others.

    Where many postings link the members of one large group to a few of them, this leaves about an edge a node.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    near = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return near.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b), both long; label is the smallest node of the component."""
    edges = materialize(contracted(contracted(edges)), "contracted")
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearest = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("over"))
        labels = materialize(nearest.join(jump, "to").select("node", F.least("to", "over").alias("label"), (F.least("to", "over") != F.col("old")).alias("changed")), "labels")
        if not labels.filter("changed").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
