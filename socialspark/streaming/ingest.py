"""Event streams: frames in, canonical tables out.

Sources are folders of frame lines or a broker's topics; both give the columns ``value``, ``relay`` and
``ingest_ts``. State is keyed by author and day, so it spreads over executors; sinks are idempotent by
batch, so a repeated micro-batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from socialspark.functions.text import packed, unpacked
from socialspark.operators import jobs
from socialspark.operators.latest import latest
from socialspark.sources.ingest import decode_frames, flatten_tags, note_zaps, profiles, split_by_shape
from socialspark.sources.scratch import cut, discard

CAPPED = (1, 6, 16, 1111)
#: States of the daily cap for each day.
CAP_BUCKETS = 64
FRAMES = "relay string, ingest_ts timestamp, value string"


def read_folder(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Frames from a folder of JSON lines (relay, ingest_ts, value)."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_topic(spark: SparkSession, servers: str, topic: str, offsets_per_batch: int = 1_000_000) -> DataFrame:
    """Frames from a broker's topic; needs its connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", offsets_per_batch).load()
    return raw.selectExpr("cast(key as string) AS relay", "timestamp AS ingest_ts", "cast(value as string) AS value")


def write_folder(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Frames as a folder of JSON lines. They are compressed: most of a frame is hexadecimal, and its copies from other relays lie beside it."""
    frames.write.mode(mode).option("compression", "gzip").json(path)


def in_file_order(spark: SparkSession, path: str) -> int:
    """Give a folder's files modification times that rise with their names, the order in which a stream reads them; how many there are."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    if files:
        start = fs.getFileStatus(files[0]).getModificationTime()
        for i, file in enumerate(files):
            fs.setTimes(file, start + 1000 * i, -1)
    return len(files)


def micro_batches(df: DataFrame, checkpoint: str, seconds: int = 5, once: bool = False) -> DataStreamWriter:
    """A writer that flushes every few seconds, or works off what is there and ends."""
    w = df.writeStream.option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")


def valid_events(frames: DataFrame) -> DataFrame:
    """Decoded events of acceptable shape, flagged where their own time is over ten minutes ahead of ingestion."""
    events, _ = split_by_shape(decode_frames(frames))
    return events.withColumn("ahead", F.col("created_at") > (F.col("ingest_ts") + F.expr("INTERVAL 10 MINUTES")).cast("timestamp_ntz"))


def seen_once(events: DataFrame, keep: str = "1 hour") -> DataFrame:
    """The first sighting of each event over all relays. The watermark is on ingestion time: an author may back-date events."""
    return once(events, ["id"], keep)


def once(events: DataFrame, key: list[str], keep: str = "1 hour") -> DataFrame:
    """The first row of each key. What is not needed after it should be left out before: all columns go to the key's state.
    Keys of 64 digits travel as 32 bytes, in tags too."""
    back = {c: unpacked(F.col(c)) for c in ("id", "pubkey") if c in events.columns}
    there = {c: packed(F.col(c)) for c in back}
    if "tags" in events.columns:
        each = lambda f: F.transform("tags", lambda tag: F.transform(tag, f))
        there["tags"], back["tags"] = each(packed), each(unpacked)
    return events.withColumns(there).withWatermark("ingest_ts", keep).dropDuplicatesWithinWatermark(key).withColumns(back)


def capped(events: DataFrame, exempt: DataFrame, cap: int, keep: str = "1 hour", buckets: int = CAP_BUCKETS) -> DataFrame:
    """Without posts beyond an author's ``cap`` of a UTC day of ingestion; exempt authors and other kinds pass.

    Of a micro-batch the first by (ingest_ts, id) stay; no more than ``cap`` of an author-day are held at once. A state holds
    the counters of a day's authors in one of ``buckets`` by their hash, so that calls do not grow with author-days. A day's
    counts leave the state when the watermark, ``keep`` behind the newest arrival, has passed its end.
    """
    free = exempt.select("pubkey").distinct().withColumn("_free", F.lit(True))
    flagged = events.withWatermark("ingest_ts", keep).join(free, "pubkey", "left")
    flagged = flagged.withColumn("_counts", F.col("kind").isin(*CAPPED) & F.col("_free").isNull()).drop("_free")
    schema = flagged.schema

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = dict(zip(*state.get, strict=True)) if state.exists else {}
        seen: dict[str, int] = {}
        first = None
        for rows in frames:
            counts = rows["_counts"].to_numpy(bool)
            if not counts.all():
                yield rows.loc[~counts, schema.names].reset_index(drop=True)
            posts = rows.loc[counts]
            for author, n in posts["pubkey"].value_counts().items():
                seen[author] = seen.get(author, 0) + n
            posts = posts[[used.get(a, 0) < cap for a in posts["pubkey"]]]
            if len(posts):
                posts = (posts if first is None else pd.concat([first, posts])).sort_values(["ingest_ts", "id"], kind="stable")
                left = [cap - used.get(a, 0) for a in posts["pubkey"]]
                first = posts[posts.groupby("pubkey").cumcount() < left]
        for author, n in seen.items():
            used[author] = min(used.get(author, 0) + int(n), cap)
        state.update((list(used), list(used.values())))
        ends = int((pd.Timestamp(key[1], tz="UTC") + pd.Timedelta(days=1)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        if first is not None:
            yield first[schema.names].reset_index(drop=True)

    day = flagged.withColumns({"_bucket": F.pmod(F.xxhash64("pubkey"), F.lit(buckets)), "_day": F.to_date("ingest_ts")}).groupBy("_bucket", "_day")
    return day.applyInPandasWithState(step, schema, "authors array<string>, used array<long>", "append", GroupStateTimeout.EventTimeTimeout).drop("_counts")


def relay_marks(events: DataFrame, back: str = "5 minutes") -> DataFrame:
    """(relay, mark, resume_at): each relay's newest event time, without events ahead of their arrival, and where to resume from after a stop."""
    marks = events.where("NOT ahead").groupBy("relay").agg(F.max("created_at").alias("mark"))
    return marks.withColumn("resume_at", (F.col("mark") - F.expr(f"INTERVAL {back}")).cast("timestamp_ntz"))


def write_table(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for complete mode: each batch's table in a folder of its own; the last one counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


class ExemptAuthors:
    """The exemption set of the cap, refreshed between batches; a load that fails leaves the last good copy in place."""

    def __init__(self, load: Callable[[], DataFrame]):
        self.load, self.copy, self.error = load, None, None

    def refresh(self) -> bool:
        try:
            new = cut(self.load().select("pubkey").distinct(), "exempt-authors")
        except Exception as e:  # whatever stops a load; kept for the caller to report
            self.error = e
            if self.copy is None:
                raise
            return False
        old, self.copy, self.error = self.copy, new, None
        if old is not None:
            discard(old)
        return True


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events per hour and kind of ingestion, with late data up to ten minutes."""
    w = events.withWatermark("ingest_ts", "10 minutes").groupBy(F.window("ingest_ts", "1 hour"), "kind").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("hour"), "kind", "n")


#: Row-level tables that a batch of events adds to; aggregates are taken when they are read, and rows written more than once
#: count once then (:func:`read_view`), so neither a batch's events nor its rows are shuffled to find repeats.
VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "events": lambda e: e.select("id", "pubkey", "kind", "created_at", "tags", "content"),
    "likes": lambda e: flatten_tags(e).where(f"kind = 7 AND {jobs.REFERENCE}").select(F.col("tag_value").alias("target_event_id"), "pubkey"),
    "reposts": lambda e: flatten_tags(e).where(f"kind IN (6, 16) AND {jobs.REFERENCE}").select(F.col("tag_value").alias("target_event_id"), "pubkey"),
    "quotes": lambda e: flatten_tags(e).where("kind = 1 AND tag_key = 'q' AND octet_length(tag_value) = 64").select(F.col("tag_value").alias("target_event_id"), "event_id"),
    "posts": lambda e: e.where("kind IN (1, 1111)").select("pubkey", "id"),
    "zaps": note_zaps,
    "contacts": jobs.contacts_latest,
    "profiles": profiles,
    "candidates": lambda e: jobs.notification_rows(flatten_tags(e)),
}


#: Views whose newest row of a key counts, over all batches.
LATEST = {"contacts": "pubkey", "profiles": "pubkey"}


def read_view(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """A view over all its batches: rows written more than once count once; of a replaceable row the newest version counts, however late it came."""
    rows = spark.read.option("basePath", f"{base}/{name}").schema(schema).parquet(f"{base}/{name}/batch=*").drop("batch")
    if name in LATEST:
        return latest(rows, [LATEST[name]], [F.desc("created_at"), F.desc("event_id")])
    text = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
    once = rows.withColumns({c: packed(F.col(c)) for c in text}).distinct()  # keys of 64 digits travel as 32 bytes
    return once.withColumns({c: unpacked(F.col(c)) for c in text})


def write_views(base: str, names: tuple[str, ...] = tuple(VIEWS)) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each view's rows of a batch go to a folder of that batch, replaced if it is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.drop("relay", "ingest_ts", "ahead", "sig").persist()
        try:
            for name in names:
                VIEWS[name](rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{name}/batch={batch_id}")
        finally:
            rows.unpersist()

    return write


def annotate(base: str, processor: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores a processor's rows; the checkpoint moves on only after the write.

    A processor is a function from events to metric rows. Events it gives no row for go to ``skipped``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read twice; without it the stream's state would be worked through again
        try:
            rows, path = processor(batch), f"{base}/metrics/batch={batch_id}"
            schema = rows.schema
            rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
            done = batch.sparkSession.read.schema(schema).parquet(path).select(F.col("event_id").alias("id")).distinct()
            batch.select("id").join(done, "id", "left_anti").write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/skipped/batch={batch_id}")
        finally:
            batch.unpersist()

    return write
