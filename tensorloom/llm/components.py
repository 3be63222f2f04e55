"""Connected components by contraction, on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``label``, the least id of its component, for each end of an edge.

    ``edges`` has columns ``a`` and ``b``.  Each round points every node at
    its least neighbour or itself, follows the pointers to their ends, and
    contracts the edges; the number of edges at least halves with the roots.
    Tables are written between steps, so that joins with a hot node are plain
    sort-merge joins, which Spark can split, and a lost executor costs little.
    """
    labels = None
    edges = edges.select("a", "b")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "parent")
        while True:
            up = parent.select(F.col("id").alias("over"), F.col("label").alias("top"))
            jumped = stored(parent.join(up, parent["label"] == up["over"], "left").select("id", F.coalesce("top", "label").alias("label"), (F.coalesce("top", "label") != F.col("label")).alias("moved")), "jumped")
            parent = jumped.select("id", "label")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("id").alias("over"), F.col("label").alias("top"))
            labels = stored(labels.join(up, labels["label"] == up["over"], "left").select("id", F.coalesce("top", "label").alias("label")), "labels")
        left, right = parent.select(F.col("id").alias("a"), F.col("label").alias("la")), parent.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        edges = stored(edges.join(left, "a").join(right, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
