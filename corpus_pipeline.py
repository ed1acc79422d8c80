"""A corpus pipeline: toxicity filter, near-duplicate removal, decontamination, mixing, sharding.

Every stage takes what its predecessor kept, as Parquet. Documents that a stage rejects are gone for the next ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.llm.decontaminate import find_leaks
from skyloom.llm.mixing import apply_plan, keyed, plan
from skyloom.llm.near_dedup import near_duplicates
from skyloom.llm.sharding import shard_documents
from skyloom.llm.store import table, written
from skyloom.llm.toxicity import score_toxicity


def _unused(name: str, columns: list[str]) -> str:
    """`name`, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go. Null, empty and unlabelled ones are judged like others; repeated rows get one verdict; any further columns stay."""
    return score_toxicity(docs, table(spark, sf_dir, "labels"), keep_row=True).where("NOT toxic").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document of smallest id stays.

    Texts without words are near duplicates of nothing and stay. If an id is null or repeats, every row is a document
    of its own: rows are numbered, and of each group one row stays, whatever its id.
    """
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        gone = written(near_duplicates(docs).where("NOT kept").select("doc_id"), "gone")
        return docs.join(gone.hint("shuffle_merge"), "doc_id", "left_anti").select(*docs.columns)
    row = _unused("_row", docs.columns)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    gone = written(near_duplicates(numbered, id_col=row).where("NOT kept").select(F.col("doc_id").alias(row)), "gone")
    return numbered.join(gone.hint("shuffle_merge"), row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay; repeated rows get one verdict; columns of any name stay as they are."""
    hits = _unused("hits", docs.columns)
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), hits_col=hits).where(F.size(hits) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times. Documents without words count nothing and get their source's copies; a null source is one of its own; rows with equal id and text get equal copies; columns of any name stay as they are."""
    packed = keyed(docs.select("doc_id", "text", "source", F.struct("*").alias("row"))).select("row", "source", "_size", "_h")
    rows = written(packed.select("source", F.col("_size").alias("size"), F.col("_h").alias("h")), "sizes")
    taken = apply_plan(packed.drop("_size"), plan(rows), h="_h").where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in 16 shards, one row a document; null texts have no bytes, repeated rows get places of their own, further columns are not read."""
    return shard_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]

#: SQL can't express the first three stages; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
