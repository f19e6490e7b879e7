"""Connected components of a graph whose links are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a long, b long); a component is named by its least node.

    Each round a node takes the least label among its own, its neighbours' and its label's label, until none changes:
    about as many rounds as the logarithm of the longest shortest path. Labels are staged each round, and those of the
    round before deleted. No links give no nodes; loops and repeated links change nothing.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.lit(None).cast("long").alias("old"), F.least("node", "m").alias("component")), "labels")
    while True:
        now = labels.select("node", "component")
        near = both.join(now.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        least = now.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        above = now.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = staged(least.join(above, "component", "left").select("node", "old", F.least("component", "above").alias("component")), "labels")
        discard(labels)
        labels = new
        if new.filter("old != component").isEmpty():
            discard(both)
            done = labels.select("node", "component")
            done.scratch = labels.scratch
            return done
