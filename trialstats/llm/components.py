"""Connected components of an edge table by the smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the component's smallest node.

    Each round takes the smallest label among the neighbours (combined before the shuffle, so hubs are cheap) and
    then the label's own label, which halves long chains. Rounds end when nothing changes; each ends in a written
    table.
    """
    both = common.written(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "both"
    )
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hung = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = hung.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        after = common.written(after, "labels")
        labels = after.drop("old")
        if after.filter("label <> old").isEmpty():
            return labels
