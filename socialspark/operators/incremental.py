"""Roll-up of touched keys: engagement features kept up to date from new events alone.

State lies in tables bucketed by the target: ``acts`` (one row per engagement and target: like, repost, reply, quote, zap),
``notes`` (author, kind and time of every event that can be a target) and ``features``, with keys of 64 digits in 32 bytes. A
tick reads the events that arrived since its cursor, adds their rows to the buckets they fall in, and works out again the
features of touched targets only: those that new events name, and new events that older ones had named already. Tables
are only added to, each row with the number of its tick, and are joined bucket by bucket, so that what was stored is neither
shuffled nor written again; of a target's features the last tick's count. Rows are keyed by the event they come from and
repeats are left out in reading, so a tick that is repeated after a crash changes nothing; the cursor is stored last.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from socialspark.functions.text import packed, unpacked
from socialspark.operators import jobs
from socialspark.sources.ingest import flatten_tags, note_zaps
from socialspark.sources.scratch import exists

BUCKETS = 64
ACTS = "event_id binary, actor binary, what string, sats long, source_id binary, tick long"
NOTES = "event_id binary, pubkey binary, kind int, created_at timestamp_ntz, tick long"
COUNTERS = ("likes", "reposts", "replies", "quotes", "zaps", "sats")
REAL = ("real_likes", "real_reposts", "real_replies", "real_quotes", "real_zaps", "real_zap_sats", "real_actors")
FEATURES = "event_id binary, pubkey binary, kind int, created_at timestamp_ntz, " + "".join(f"{c} long, " for c in ("raw_" + n for n in COUNTERS)) + "".join(f"{c} long, " for c in REAL) + "tick long"
TARGET_KINDS = (1, 1111)


@dataclass(frozen=True)
class Tick:
    """What a tick did: new events, touched targets, the buckets they fall in."""

    events: int
    targets: int
    buckets: int


def acts_of(events: DataFrame) -> DataFrame:
    """(event_id, actor, what, sats, source_id): engagements in some events, for each target they name; keys packed. An event
    that names a target twice gives the row twice."""
    tags = flatten_tags(events)
    key = lambda c: packed(F.col(c))
    act = lambda df, target, actor, what, source, sats="cast(0 as bigint)": df.select(key(target).alias("event_id"), key(actor).alias("actor"), F.lit(what).alias("what"), F.expr(sats).alias("sats"), key(source).alias("source_id"))
    out = act(tags.where(f"kind = 7 AND {jobs.REFERENCE}"), "tag_value", "pubkey", "like", "event_id")
    for more in (
        act(tags.where(f"kind IN (6, 16) AND {jobs.REFERENCE}"), "tag_value", "pubkey", "repost", "event_id"),
        act(jobs.reply_edges(tags), "parent_id", "child_pubkey", "reply", "child_id"),
        act(tags.where("kind = 1 AND tag_key = 'q' AND octet_length(tag_value) = 64"), "tag_value", "pubkey", "quote", "event_id"),
        act(note_zaps(events), "target_event_id", "pubkey", "zap", "zap_receipt_id", "sats"),
    ):
        out = out.unionByName(more)
    return out


def features(acts: DataFrame, notes: DataFrame, reputable: DataFrame) -> DataFrame:
    """Counters of every target in ``notes`` that has acts: raw ones over all actors, real ones over reputable actors other than
    the author. All by target, but for the actors' reputation, which joins rows summed by target and actor."""
    known = reputable.select(packed(F.col("pubkey")).alias("actor")).distinct().withColumn("good", F.lit(True))
    whats = ("like", "repost", "reply", "quote", "zap")
    rows = acts.dropDuplicates(["event_id", "what", "source_id"]).join(notes.select("event_id", F.col("pubkey").alias("author")), "event_id")
    by_actor = rows.groupBy("event_id", "actor").agg(
        *[F.count_if(F.col("what") == w).alias(w) for w in whats], F.sum("sats").alias("sats"), F.first(F.col("actor") != F.col("author")).alias("other"))
    j = by_actor.join(known, "actor", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    once, other = lambda w: F.col(w) > 0, F.col("good") & F.col("other")
    totals = j.groupBy("event_id").agg(
        F.count_if(once("like")).alias("raw_likes"), F.count_if(once("repost")).alias("raw_reposts"), F.sum("reply").alias("raw_replies"), F.sum("quote").alias("raw_quotes"), F.sum("zap").alias("raw_zaps"), F.sum("sats").alias("raw_sats"),
        *[F.count_if(once(w) & other).alias(f"real_{n}") for w, n in zip(whats[:4], ("likes", "reposts", "replies", "quotes"), strict=True)],
        F.count_if(once("zap") & F.col("good")).alias("real_zaps"), F.coalesce(F.sum(F.when(F.col("good"), F.col("sats"))), F.lit(0)).alias("real_zap_sats"), F.count_if(other).alias("real_actors"),
    )
    return notes.select("event_id", "pubkey", "kind", "created_at").join(totals, "event_id")


class RollUp:
    """The stored state and features under ``base``, always opened with the same number of ``buckets``."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, base, buckets

    def _table(self, name: str, schema: str) -> str:
        """The catalog's name of a state table; its files are all that lasts."""
        known = f"{name}_{sha256(self.base.encode()).hexdigest()[:32]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({schema}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (event_id) INTO {self.buckets} BUCKETS LOCATION '{self.base}/{name}'")
        return known

    def _read(self, name: str, schema: str) -> DataFrame:
        known = self._table(name, schema)
        self.spark.catalog.refreshTable(known)
        return self.spark.table(known)

    def _add(self, name: str, schema: str, rows: DataFrame, tick: int) -> None:
        """Rows are dealt out by target once, so that each bucket gets a file."""
        known = self._table(name, schema)
        dealt = rows.withColumn("tick", F.lit(tick).cast("long")).repartition(self.buckets, "event_id")
        once = ["event_id", "what", "source_id"] if name == "acts" else ["event_id"]
        dealt.dropDuplicates(once).select(*[c.split()[0] for c in schema.split(", ")]).sortWithinPartitions("event_id").write.insertInto(known)

    def features(self) -> DataFrame:
        rows = self._read("features", FEATURES)
        newest = rows.withColumn("_last", F.max("tick").over(Window.partitionBy("event_id"))).where("tick = _last").drop("_last", "tick")
        return newest.withColumns({c: unpacked(F.col(c)) for c in ("event_id", "pubkey")})

    def cursor(self) -> datetime | None:
        if not exists(self.spark, f"{self.base}/cursor"):
            return None
        return self.spark.read.schema("at timestamp_ntz").parquet(f"{self.base}/cursor").agg(F.max("at")).first()[0]

    def tick(self, log: DataFrame, scores: DataFrame, arrived: str = "created_at", min_score: float = 50.0, rescored: DataFrame | None = None) -> Tick:
        """Take the rows of ``log`` (canonical events) that arrived after the cursor. The log is read more than once, up to the
        newest arrival that the first reading found. ``rescored`` (pubkey): actors whose reputation changed since; targets that
        they acted on are worked out again."""
        since = self.cursor()
        new = log if since is None else log.where(F.col(arrived) > F.lit(since))
        seen = new.agg(F.count("*").alias("n"), F.max(arrived).alias("at")).first()
        new = new.where(F.coalesce(F.col(arrived) <= F.lit(seen.at).cast("timestamp_ntz"), F.lit(True)))
        last = [self._read(n, s).agg(F.max("tick")).first()[0] for n, s in (("acts", ACTS), ("notes", NOTES), ("features", FEATURES))]
        number = max((n for n in last if n is not None), default=-1) + 1
        if seen.n:
            self._add("acts", ACTS, acts_of(new), number)
            self._add("notes", NOTES, new.where(F.col("kind").isin(*TARGET_KINDS)).select(packed(F.col("id")).alias("event_id"), packed(F.col("pubkey")).alias("pubkey"), "kind", "created_at"), number)
        acts, notes = self._read("acts", ACTS), self._read("notes", NOTES)
        marks = [t.where(F.col("tick") == number) for t in (acts, notes)]
        if rescored is not None:
            marks.append(acts.join(rescored.select(packed(F.col("pubkey")).alias("actor")).distinct(), "actor", "left_semi"))
        marks = [m.select("event_id").distinct().withColumn(f"_{k}", F.lit(True)) for k, m in enumerate(marks)]
        touched = reduce(lambda a, b: a.join(b.hint("merge"), "event_id", "full"), marks).select(F.pmod(F.hash("event_id"), F.lit(self.buckets)).alias("bucket"))
        size = touched.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.sum("n").alias("targets"), F.count("*").alias("buckets")).first()
        named = reduce(lambda a, b: a | b, [F.col(f"_{k}").isNotNull() for k in range(len(marks))])
        only = lambda df: reduce(lambda a, b: a.join(b.hint("merge"), "event_id", "left"), marks, df).where(named).select(*df.columns)
        fresh = features(only(acts), only(notes).dropDuplicates(["event_id"]), jobs.scored_actors(scores, min_score))
        if size.buckets:
            self._add("features", FEATURES, fresh, number)
        if seen.at is not None:
            self.spark.createDataFrame([(seen.at,)], "at timestamp_ntz").write.mode("append").parquet(f"{self.base}/cursor")
        return Tick(seen.n, size.targets or 0, size.buckets)
