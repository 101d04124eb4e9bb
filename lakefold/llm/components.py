"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.session import written


#: Bound for safety only: each round joins every unfinished tree to another, so rounds are logarithmic in the nodes.
LIMIT = 200


def components(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """edges: a, b bigint. A row for each node of an edge: node, label, the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, gives it to the node's old label too (the
    smallest that any of its members saw), and follows labels once; labels are written to the shared folder each round,
    so lineage stays short. Ends when no label changes; raises if limit rounds do not do.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(limit):
        near = both.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        best = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        hooks = best.where("best < label").groupBy(F.col("label").alias("node")).agg(F.min("best").alias("hook"))
        best = written(best.join(hooks, "node", "left").select("node", "label", F.least("best", F.coalesce("hook", "best")).alias("best")), "hooked")
        jump = best.join(best.select(F.col("node").alias("best"), F.col("best").alias("further")), "best", "left")
        new = written(jump.select("node", F.least("best", F.coalesce("further", "best")).alias("label"), F.col("label").alias("was")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components: labels still change after {limit} rounds")
