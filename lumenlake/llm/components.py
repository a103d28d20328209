"""Connected components of a graph whose vertices have few neighbours each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """vertex, component (the smallest vertex reachable) of ``links`` (a, b: both long, none null).

    Each round every vertex takes the smallest label among its neighbours, then the label of its label, so
    that long chains shorten by half or more. Joins are on the vertex, which has few neighbours, or on
    labels with both sides freshly shuffled, where Spark splits a large one. Nothing but a count of changes
    comes to the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpoint(both.filter("a <> b").distinct())
    labels = checkpoint(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("vertex"), F.least("a", "least").alias("component")))
    while True:
        offered = edges.join(labels, edges["b"] == labels["vertex"]).select(F.col("a").alias("vertex"), "component")
        nearest = checkpoint(labels.union(offered).groupBy("vertex").agg(F.min("component").alias("component")))
        above = nearest.select(F.col("vertex").alias("component"), F.col("component").alias("above"))
        jumped = checkpoint(nearest.join(above, "component").select("vertex", F.col("above").alias("component")))
        old = labels.select("vertex", F.col("component").alias("old"))
        changed = jumped.join(old, "vertex").filter("component <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels
