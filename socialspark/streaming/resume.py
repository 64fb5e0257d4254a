"""Resuming from each relay's mark after a checkpoint is lost.

Frames lie in a landing folder by day of arrival. A run stores its events and, with every micro-batch, the newest event
time of each relay (its mark; events ahead of their arrival do not move it). A new run with a new checkpoint reads
[mark - 5 minutes, ...) of each relay, from the landing days that can hold it, and drops what earlier runs stored.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from socialspark.sources.scratch import exists
from socialspark.streaming.ingest import FRAMES, micro_batches, once as once_by, relay_marks, valid_events

EVENT_ROW = "id string, pubkey string, kind int, created_at timestamp_ntz, relay string"
#: Events further ahead of their arrival do not move a mark.
AHEAD = timedelta(minutes=10)


def land(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Frames into the landing folder."""
    frames.withColumn("day", F.to_date("ingest_ts")).write.mode(mode).option("compression", "gzip").partitionBy("day").json(path)


def read_landing(spark: SparkSession, path: str, since_day: str | None = None, files_per_batch: int = 100) -> DataFrame:
    """Frames of the landing folder; with ``since_day`` only the files of that day and later are read."""
    rows = spark.readStream.schema(f"{FRAMES}, day date").option("maxFilesPerTrigger", files_per_batch).json(path)
    return (rows.where(F.col("day") >= F.lit(since_day).cast("date")) if since_day else rows).drop("day")


def stored_marks(spark: SparkSession, base: str, before_run: int | None = None) -> DataFrame:
    """relay, mark, resume_at over all batches of all runs (or of those before one); one row a relay."""
    schema = "relay string, mark timestamp_ntz, run int, batch int"
    rows = spark.read.schema(schema).parquet(f"{base}/marks") if exists(spark, f"{base}/marks") else spark.createDataFrame([], schema)
    if before_run is not None:
        rows = rows.where(F.col("run") < before_run)
    marks = rows.groupBy("relay").agg(F.max("mark").alias("mark"))
    return marks.withColumn("resume_at", (F.col("mark") - F.expr("INTERVAL 5 MINUTES")).cast("timestamp_ntz"))


def stored_sightings(spark: SparkSession, base: str) -> DataFrame:
    """Every event once for each relay that sent it, over all runs."""
    return spark.read.schema(f"{EVENT_ROW}, run int, batch int").parquet(f"{base}/events")


def store(base: str, run: int, earlier: DataFrame | None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: events first, then the marks they give; both are replaced if a batch is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            new = rows if earlier is None else rows.join(earlier, ["id", "relay"], "left_anti")
            new.select("id", "pubkey", "kind", "created_at", "relay").write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/events/run={run}/batch={batch_id}")
            relay_marks(rows).select("relay", "mark").write.mode("overwrite").parquet(f"{base}/marks/run={run}/batch={batch_id}")
        finally:
            rows.unpersist()

    return write


def run_number(spark: SparkSession, base: str, checkpoint: str) -> int:
    """The run that a checkpoint belongs to; a new one, written down first, where the checkpoint is gone or was never there."""
    schema = "checkpoint string, run int"
    runs = [] if not exists(spark, f"{base}/runs") else spark.read.schema(schema).parquet(f"{base}/runs").collect()  # one row a start
    own = [r.run for r in runs if r.checkpoint == checkpoint]
    if own and exists(spark, f"{checkpoint}/offsets"):
        return max(own)
    run = max((r.run for r in runs), default=-1) + 1
    spark.createDataFrame([(checkpoint,)], "checkpoint string").write.mode("overwrite").parquet(f"{base}/runs/run={run}")
    return run


def start(spark: SparkSession, landing: str, base: str, checkpoint: str, files_per_batch: int = 100, once: bool = True) -> StreamingQuery:
    """Start a run, or go on with the one whose checkpoint is there.

    What it reads depends on the runs before it alone: all frames for the first run, else each relay's from its mark
    less five minutes. A relay without a mark is read from the first landing day that any relay needs.
    """
    run = run_number(spark, base, checkpoint)
    marks, earlier, since = stored_marks(spark, base, run), None, None
    low = marks.agg(F.min("resume_at")).first()[0]
    if low is not None:
        # what earlier runs hold of the overlap, and events that claimed a later time: little, whatever the log's size
        earlier = stored_sightings(spark, base).where((F.col("run") < run) & (F.col("created_at") >= F.lit(low))).select("id", "relay")
        since = str((low - AHEAD).date())
    events = valid_events(read_landing(spark, landing, since, files_per_batch)).select("id", "pubkey", "kind", "created_at", "relay", "ahead", "ingest_ts")
    if low is not None:
        events = events.join(marks.select("relay", "resume_at"), "relay", "left").where("resume_at IS NULL OR created_at >= resume_at").drop("resume_at")
    return micro_batches(once_by(events, ["id", "relay"]), checkpoint, once=once).foreachBatch(store(base, run, earlier)).start()
