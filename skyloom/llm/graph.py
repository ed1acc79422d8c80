"""Connected components on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of edges (a, b): component is the smallest id reachable.

    Each round takes the least label among neighbours (partial aggregation, so hubs are summed before the
    shuffle) and then jumps to the label's own label, so rounds grow with the logarithm of a chain's length.
    Self-loops and repeated edges are allowed; null ends are dropped; no edges give no rows.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    e = written(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = e.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        after = written(step.join(jump, "c").select("id", F.least("c", "cc").alias("component"), (F.least("c", "cc") < F.col("component")).alias("moved")), "labels")
        labels = after.select("id", "component")
        if after.where("moved").isEmpty():
            return labels
