"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import dropped, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it reaches.

    Each round takes the smallest label among the neighbours and then the label's own label,
    so that chains halve. Labels are written to the shared folder after each round.
    """
    both = staged(edges.select("a", "b").where("a <> b").unionByName(edges.selectExpr("b as a", "a as b").where("a <> b")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    table = labels
    while True:
        near = both.join(labels.selectExpr("node as b", "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        heads = labels.selectExpr("node as component", "component as head")
        stepped = staged(lower.join(heads, "component", "left").select("node", "was", F.least("component", "head").alias("component")), "labels")
        dropped(table)
        labels, table = stepped.select("node", "component"), stepped
        if not stepped.where("component <> was").limit(1).count():
            dropped(both)
            return labels
