"""Connected components of a graph of links, by the least label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.arrow import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, label): the least node that each node is joined to. Nodes without a link have no row.

    A step gives each node the least label around it and then its label's label, so a star takes two steps and a chain
    about the logarithm of its length. Labels are written after each step; only a count reaches the driver. Hot nodes
    meet in joins, which Spark splits, and in sums of a row for each key and task.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # a label is a node with a link, so it has a label itself
        lower = labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = lower.join(up, "label").select("node", F.least("label", "further").alias("label"), "was")
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return labels
