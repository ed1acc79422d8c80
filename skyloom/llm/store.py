"""Tables written to the shared folder, so that later jobs neither recompute nor depend on one executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on a single machine (tests), one of our own. A cluster must name one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back: a cut of the lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
