"""Graphs as edge tables: components, adjacency, neighbours."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a Parquet table in the folder of spark.checkpoint.dir, which all executors share."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) both ways, once; loops and nulls dropped."""
    e = edges.where("a <> b").select("a", "b")
    return e.union(e.select("b", "a")).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the least id that is reachable. Nodes without edges are their own component.

    Labels fall by the least neighbour's label and then jump to their label's label, so rounds grow with the
    logarithm of a component's diameter.
    """
    e = written(undirected(edges), "edges")
    label = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"))
    moved = True
    while moved:
        label = written(label, "labels")
        least = e.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = label.join(least, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = label.select(F.col("id").alias("c"), F.col("component").alias("further"))
        after = written(step.join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("further", "c")).alias("component")), "labels")
        moved = not after.where("component < old").isEmpty()
        label = after.select("id", "component")
    if nodes is not None:
        label = nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return label


def second_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b) two steps apart and not one."""
    e = undirected(edges)
    two = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("a <> c").select("a", F.col("c").alias("b")).distinct()
    return two.join(e, ["a", "b"], "left_anti")
