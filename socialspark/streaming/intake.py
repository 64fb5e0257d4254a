"""Intake with a daily cap whose exemptions change while the stream runs.

Two queries in a row. The first one (:func:`by_exemption`) looks at the exemption set again in every micro-batch and
writes each event once, as passed or as counted. The second one (:func:`counted_posts`) takes the counted ones through
value state on the RocksDB store: keyed by (UTC day of arrival, bucket of authors), one counter an author, for all
authors. Only if a ``bound`` is asked for, authors beyond that many a day are not counted and their posts pass; who comes
first within a micro-batch is then told by arrival in each Arrow batch. A day's counters go when the watermark has passed its end.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from socialspark.sources.scratch import exists
from socialspark.streaming.ingest import CAPPED, ExemptAuthors, micro_batches

BUCKETS = 64
REFRESH_SECONDS = 15 * 60
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RefreshedExemption:
    """The exemption set as a running stream sees it: loaded when it is first asked for and again once ``every`` seconds
    have gone by; a load that fails leaves the last good copy; None, so that all are exempt, while no load succeeded."""

    def __init__(self, load: Callable[[], DataFrame], every: float = REFRESH_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.authors, self.every, self.clock, self.tried = ExemptAuthors(load), every, clock, None

    @property
    def error(self) -> Exception | None:
        return self.authors.error

    def current(self) -> DataFrame | None:
        now = self.clock()
        if self.tried is None or now - self.tried >= self.every:
            self.tried = now
            try:
                self.authors.refresh()
            except Exception as e:  # never loaded so far: kept for the caller to report, and everyone is exempt
                self.authors.error = e
        return self.authors.copy


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table that :func:`publish` writes; fails while there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    done = [n for n in names if n.startswith("version=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    if not done:
        raise FileNotFoundError(f"no complete version in {path}")
    return spark.read.schema("pubkey string").parquet(f"{path}/{max(done, key=lambda n: int(n.split('=')[1]))}")


def publish(authors: DataFrame, path: str, version: int) -> None:
    """A new version of an exemption table; readers of the one before are not disturbed."""
    authors.select("pubkey").distinct().write.mode("overwrite").parquet(f"{path}/version={version}")


def by_exemption(base: str, exemption: RefreshedExemption) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each event once under ``split``, with ``counted`` 1 where the cap applies.

    A batch that was written to its end stays as it is when it is repeated, with the exemptions of its first run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{base}/split/batch={batch_id}"
        if exists(batch.sparkSession, f"{path}/_SUCCESS"):
            return
        free = exemption.current()
        if free is None:
            flagged = batch.withColumn("counted", F.lit(0))
        else:
            known = free.select("pubkey").withColumn("_free", F.lit(True))
            applies = F.col("kind").isin(*CAPPED) & F.col("_free").isNull()
            flagged = batch.join(known, "pubkey", "left").withColumn("counted", applies.cast("int")).drop("_free")
        flagged.write.mode("overwrite").partitionBy("counted").parquet(path)

    return write


class DailyCounters(StatefulProcessor):
    """Of each author-day the first ``cap`` posts by (ingest_ts, id) of a micro-batch, after those of earlier batches."""

    def __init__(self, cap: int, bound: int | None, columns: list[str]):
        self.cap, self.bound, self.columns = cap, bound, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "pubkey string", "n long")
        self.authors = handle.getValueState("authors", "n long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.authors.get()
        if known is None:
            day_end = int((pd.Timestamp(key[0], tz="UTC") + pd.Timedelta(days=1)).timestamp() * 1000)
            self.handle.registerTimer(max(day_end, timerValues.getCurrentWatermarkInMs() + 1))
        size = before = known[0] if known else 0
        used: dict[str, int] = {}
        left: dict[str, int] = {}
        seen: dict[str, int] = {}
        uncounted: set[str] = set()
        held = None
        for frame in rows:
            for author in frame.sort_values(["ingest_ts", "id"], kind="stable")["pubkey"].unique():
                if author in left or author in uncounted:
                    continue
                if self.used.containsKey((author,)):
                    used[author] = self.used.getValue((author,))[0]
                elif self.bound is None or size < self.bound:
                    used[author], size = 0, size + 1
                else:
                    uncounted.add(author)
                    continue
                left[author] = max(self.cap - used[author], 0)
            free = frame["pubkey"].isin(uncounted)
            if free.any():
                yield frame.loc[free, self.columns].reset_index(drop=True)
            counted = frame.loc[~free]
            for author, n in counted["pubkey"].value_counts().items():
                seen[author] = seen.get(author, 0) + int(n)
            held = pd.concat([held, counted]).sort_values(["ingest_ts", "id"], kind="stable") if held is not None else counted.sort_values(["ingest_ts", "id"], kind="stable")
            held = held[held.groupby("pubkey").cumcount() < held["pubkey"].map(left)]  # never more than cap rows an author
        for author, n in seen.items():
            if left[author]:  # a full counter does not change any more
                self.used.updateValue((author,), (min(used[author] + n, self.cap),))
        if size != before or known is None:
            self.authors.update((size,))
        if held is not None and len(held):
            yield held[self.columns].reset_index(drop=True)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.used.clear()
        self.authors.clear()
        return iter(())

    def close(self) -> None:
        pass


def counted_posts(counted: DataFrame, cap: int, bound: int | None = None, buckets: int = BUCKETS, keep: str = "1 hour") -> DataFrame:
    """Posts within their author's cap; ``bound``: counters a day, if they are to be bounded. Start it inside :func:`rocksdb_state`."""
    schema = counted.schema
    keyed = counted.withWatermark("ingest_ts", keep).withColumns({"_day": F.to_date("ingest_ts"), "_bucket": F.pmod(F.xxhash64("pubkey"), F.lit(buckets)).cast("int")})
    counters = DailyCounters(cap, None if bound is None else max(bound // buckets, 1), schema.names)
    return keyed.groupBy("_day", "_bucket").transformWithStateInPandas(counters, schema, "Append", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def read_split(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """What :func:`by_exemption` wrote, as a stream of the counted events."""
    return spark.readStream.schema(f"{schema}, batch int, counted int").parquet(f"{base}/split").where("counted = 1").drop("batch", "counted")


def start_split(events: DataFrame, base: str, exemption: RefreshedExemption, once: bool = False, seconds: int = 5) -> StreamingQuery:
    return micro_batches(events, f"{base}/state-split", seconds, once).foreachBatch(by_exemption(base, exemption)).start()


def start_counting(spark: SparkSession, base: str, schema: str, cap: int, once: bool = False, seconds: int = 5, **sizes) -> StreamingQuery:
    with rocksdb_state(spark):
        kept = counted_posts(read_split(spark, base, schema), cap, **sizes)
        return micro_batches(kept, f"{base}/state-counts", seconds, once).format("parquet").option("path", f"{base}/kept").outputMode("append").start()


def read_intake(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Events let through so far: the passed ones and the kept ones, each id once."""
    passed = spark.read.schema(f"{schema}, batch int, counted int").option("basePath", f"{base}/split").parquet(f"{base}/split/batch=*").where("counted = 0").drop("batch", "counted")
    kept = spark.read.schema(schema).parquet(f"{base}/kept") if exists(spark, f"{base}/kept") else passed.limit(0)
    return passed.unionByName(kept).dropDuplicates(["id"])
