"""Connected components of a link table, as joins and pre-aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.session import cut, drop


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, label)``: each linked node with the smallest node that it reaches.

    Each round takes the least label among the neighbours, then the label of that label, so paths halve.
    Nodes without a link aren't in the result; repeated links and links of a node to itself do no harm.
    A round's table is deleted once the next one is written.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    table = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        labels = table.select("node", "label")
        told = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("told"))
        )
        nearer = labels.join(told, "node").select("node", F.col("label").alias("was"), F.least("label", "told").alias("now"))
        ahead = labels.select(F.col("node").alias("now"), F.col("label").alias("next"))
        step = cut(
            nearer.join(ahead, "now", "left").select("node", "was", F.least("now", F.coalesce("next", "now")).alias("label")),
            "labels",
        )
        drop(table)
        table = step
        if step.where("was <> label").isEmpty():
            drop(both)
            return step.select("node", "label")
