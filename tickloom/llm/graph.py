"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import shared


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the smallest node that can be reached, for each node with a link.

    Each round every node takes the smallest label among its own, those of neighbours whose label the last round changed (the others' it has met already), and that of the
    node its label names; so labels travel along chains in steps that double, and few links are joined once most components have settled. Rounds are written to the shared
    folder, the one before is removed.
    """
    both = links.select("a", "b").where("a <> b")
    both = shared.written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    step = shared.written(step.select("node", "component", F.col("node").alias("was")), "labels")
    while True:
        labels = step.select("node", "component")
        moved = step.where("component <> was").select(F.col("node").alias("moved"), F.col("component").alias("to"))
        if moved.isEmpty():
            return labels
        near = both.join(moved, both["b"] == moved["moved"]).groupBy("a").agg(F.min("to").alias("near"))
        nearer = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        named = labels.select(F.col("node").alias("named"), F.col("component").alias("further"))
        nearer = nearer.join(named, F.col("to") == F.col("named")).select("node", F.least("to", "further").alias("component"), "was")
        last, step = step, shared.written(nearer, "labels")
        shared.removed(last)
