"""Sharding by fixed virtual slots and a versioned slot-to-shard map. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .store import written

N_SLOTS = 4096


def records(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): a record's slot is a hash of its id and text, so that neither a hot id nor a hot text fills one slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    r = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return r.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(n_slots)).cast("int"))


def first_map(spark, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: slots dealt in turn. Columns version, virtual_slot, shard."""
    return spark.range(n_slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % n_shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, slot_bytes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map: (version, virtual_slot, shard).

    Each shard keeps its largest slots while they fit the mean load; the other slots, by falling size, go
    to the shard that is lightest by then. Slots are thousands at most, whatever the data, so the one row that
    holds them has a fixed bound. Shards that the old map doesn't know start empty.
    """
    s = slot_map.join(F.broadcast(slot_bytes), "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    total = s.agg(F.sum("bytes").alias("total"))
    w = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    s = s.crossJoin(F.broadcast(total)).withColumn("stays", (F.sum("bytes").over(w) * n_shards <= F.col("total")) & (F.col("shard") < n_shards))
    one = s.agg(
        F.max("version").alias("version"),
        F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("pool"),
        F.collect_list(F.when(F.col("stays"), F.struct("virtual_slot", "shard"))).alias("kept"),
        *[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == i), F.col("bytes"))), F.lit(0)).alias(f"l{i}") for i in range(n_shards)],
    )
    loads = ", ".join(f"l{i}" for i in range(n_shards))
    dealt = F.expr(
        f"""aggregate(array_sort(pool), named_struct('loads', array({loads}), 'at', cast(array() AS array<int>)),
        (a, x) -> named_struct(
          'loads', transform(a.loads, (v, i) -> IF(i = array_position(a.loads, array_min(a.loads)) - 1, v - x.less, v)),
          'at', array_append(a.at, cast(array_position(a.loads, array_min(a.loads)) - 1 AS int)))).at"""
    )
    one = one.withColumn("moved", F.expr("array_sort(pool)")).withColumn("at", dealt)
    every = F.expr("concat(kept, transform(moved, (x, i) -> named_struct('virtual_slot', x.virtual_slot, 'shard', at[i])))")
    return one.select((F.col("version") + 1).alias("version"), F.explode(every).alias("x")).select("version", "x.virtual_slot", "x.shard")


def stored_map(spark, map_path: str) -> DataFrame | None:
    """The latest version of the map stored at a path; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(map_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    every = spark.read.schema("version int, virtual_slot int, shard int").parquet(map_path)
    return every.join(F.broadcast(every.agg(F.max("version").alias("version"))), "version", "left_semi")


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """One row for each row: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    Law `bytes`: shards' sizes are near equal. Records are hashed into virtual slots, bytes are summed by
    slot, and the latest version of the map stored at `map_path`, or version 0, is edited once on these sums; the
    new version is stored there, after the others (without a path, in the shared folder). The law puts no bound on
    where equal texts go: records of one text are dealt over slots by their ids, so a text that a third of all rows
    share fills no shard. Ties of slots' bytes go by slot, ties of loads to the first shard. `slot` is the row's place in its shard, gapless from 0. A null text has no bytes and CRC 0; a null
    id is an id like any other. Rows that are alike in all of this are told apart by place only. grown_shard is
    null under this law. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rec = written(records(docs, n_slots, id_col, text_col), "records")
    sums = written(rec.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "slot_sums")
    old = stored_map(spark, map_path) if map_path else None
    fresh = old is None
    old = first_map(spark, n_shards, n_slots) if fresh else written(old.select("version", "virtual_slot", "shard"), "old_map")
    new = written(rebalanced(old, sums.select("virtual_slot", "bytes"), n_shards), "slot_map")
    if map_path:
        (old.unionByName(new) if fresh else new).write.mode("append").parquet(map_path)
    latest = new.join(F.broadcast(sums), "virtual_slot").select("version", "virtual_slot", "shard", "n")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    latest = latest.select(F.col("version").alias("map_version"), "virtual_slot", "shard", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    out = rec.withColumn("place", place).join(F.broadcast(latest), "virtual_slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
