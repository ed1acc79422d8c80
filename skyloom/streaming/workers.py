"""Streams: worker states, tasks and results, and image statistics by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Device states that mean free and busy.
FREE, BUSY = ("ON",), ("RUNNING", "INIT")


def latest_states(events: DataFrame) -> DataFrame:
    """(worker, state, status, ts): the last state of each worker of events (worker, state, ts), batch or stream."""
    last = events.groupBy("worker").agg(F.max_by("state", "ts").alias("state"), F.max("ts").alias("ts"))
    status = F.when(F.col("state").isin(*FREE), "free").when(F.col("state").isin(*BUSY), "busy").otherwise("unknown")
    return last.select("worker", "state", status.alias("status"), "ts")


def free_workers(states: DataFrame, most: int) -> DataFrame:
    """At most `most` free workers, by name."""
    return states.where("status = 'free'").orderBy("worker").limit(most)


def assign_tasks(tiles: DataFrame, workers: int, most_per_worker: int = 10_000) -> DataFrame:
    """Tiles dealt in turn to workers: adds worker_id; raises if a worker would get too many."""
    n = tiles.count()
    if workers < 1 or -(-n // workers) > most_per_worker:
        raise ValueError(f"{n} tasks are too many for {workers} workers")
    return tiles.withColumn("worker_id", F.col("tile_id") % workers)


def windowed_stats(events: DataFrame, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Statistics of `value` by event-time window and type; rows later than `late` are not waited for."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("rms"), F.max("value").alias("top"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "mean", "rms", "top")


def decoded_sources(lines: DataFrame, schema: str) -> DataFrame:
    """Source events (JSON lines `value`) as rows; what can't be decoded is left out."""
    return lines.select(F.from_json("value", schema).alias("s")).where("s IS NOT NULL").select("s.*")


def run_tasks(tasks: DataFrame, do, sink: str, checkpoint: str):
    """A query that calls do(batch of tasks) -> DataFrame for each micro-batch and appends its rows to `sink`.

    A batch that is retried overwrites its own folder, so results are there once.
    """

    def one(batch: DataFrame, number: int) -> None:
        do(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return tasks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_changes(events: DataFrame) -> DataFrame:
    """(worker, old, state, ts): the events (worker, state, ts) that changed a worker's state, as subscribers get them; the first event of a worker is a change."""
    before = F.lag("state").over(Window.partitionBy("worker").orderBy("ts"))
    return events.select("worker", before.alias("old"), "state", "ts").where(~F.col("state").eqNullSafe(F.col("old")))


def registered(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(worker, since): each worker once, from its first event; `known` workers keep their date."""
    new = events.groupBy("worker").agg(F.min("ts").alias("since"))
    return new if known is None else known.select("worker", "since").unionByName(new.join(known, "worker", "left_anti"))


def listed(states: DataFrame) -> DataFrame:
    """(status, n, first_worker): how many workers there are of each status, and the first by name."""
    return states.groupBy("status").agg(F.count("*").alias("n"), F.min("worker").alias("first_worker"))


def job_attributes(changes: DataFrame) -> DataFrame:
    """(job, name, value): attributes that a job has after changes (job, name, value, ts), a null value being a removal."""
    last = changes.groupBy("job", "name").agg(F.max(F.struct("ts", "value")).alias("x"))
    return last.select("job", "name", "x.value").where("value IS NOT NULL")


def typed_options(lines: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(name, value, accepted) of JSON lines {name, value}: accepted are known names whose value can be read as their kind (long, double, boolean, string)."""
    o = lines.select(F.from_json("value", "name string, value string").alias("o")).select("o.*").where("name IS NOT NULL")
    reads = F.lit(False)
    for name, kind in sorted(kinds.items()):
        reads = reads | ((F.col("name") == name) & F.expr(f"try_cast(value AS {kind})").isNotNull())
    return o.select("name", "value", F.coalesce(reads, F.lit(False)).alias("accepted"))
