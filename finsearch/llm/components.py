"""Connected components of a graph of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.session import written


def connected(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; the label is the smallest node of the component.

    Every node hooks to its smallest smaller neighbour, the hooks are followed twice, and the links
    are drawn anew between what their ends became, until none is left. Each round is written, so
    its lineage is one step long; nothing but the number of links comes to the driver.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(links.distinct(), "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    labels = written(labels, "labels")
    while links.take(1):
        hooks = written(links.groupBy("a").agg(F.min("b").alias("to")), "hooks")
        for _ in range(2):
            further = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(further, "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        hooks = written(hooks, "hooks")
        moved = hooks.select(F.col("a").alias("label"), "to")
        labels = written(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            at = hooks.select(F.col("a").alias(end), "to")
            links = links.join(at, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        links = written(links.distinct(), "links")
    return labels
