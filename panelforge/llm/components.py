"""Connected components of a large link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); nodes have one label if and only if links connect them.

    In each round every node joins the neighbour (or itself) whose hash in this round is smallest, and links are
    redrawn between what is left. The order is drawn anew each round, so chains shrink by a share of their
    length. Rounds are cut off from their lineage in the shared folder.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    number = 0
    while not edges.isEmpty():
        best = F.min(F.struct(F.xxhash64(F.lit(number), "b").alias("h"), F.col("b").alias("to"))).alias("best")
        own = F.struct(F.xxhash64(F.lit(number), "a").alias("h"), F.col("a").alias("to"))
        step = materialise(edges.groupBy("a").agg(best).select("a", F.least("best", own)["to"].alias("to")), "step")
        labels = labels.join(step, labels["label"] == step["a"], "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = materialise(labels, "labels")
        left = edges.join(step, "a").select(F.col("to").alias("a"), "b")
        both = left.join(step.withColumnsRenamed({"a": "b", "to": "c"}), "b").select("a", F.col("c").alias("b"))
        edges = materialise(both.where("a <> b").distinct(), "links")
        number += 1
    return labels
