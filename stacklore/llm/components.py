"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is a node of the component.

    Each round sends every node to the least of its neighbours and itself, then contracts the edges, so paths shorten
    and stars vanish at once. Every round is written to the shared folder; nothing but counts comes to the driver. A
    node of very many edges is summed map-side and joined by joins that Spark can split."""
    edges = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), f"{name}-edges0")
    labels, k = None, 0
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        sent = scratch.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), f"{name}-sent{k}")
        if labels is None:
            labels = sent
        else:
            moved = labels.join(sent.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            labels = scratch.save(moved.select("node", F.coalesce("next", "root").alias("root")), f"{name}-labels{k}")
        one = sent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = sent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        cut = edges.join(one, "a").join(two, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        # a root that was itself sent on points to its own root
        chained = sent.join(sent.select(F.col("node").alias("root"), F.col("root").alias("rr")), "root").where("rr != root").select(F.col("rr").alias("a"), F.col("root").alias("b")).distinct()
        edges = scratch.save(cut.unionByName(chained).distinct(), f"{name}-edges{k + 1}")
        if edges.isEmpty():
            return labels
        k += 1
