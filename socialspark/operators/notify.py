"""Notification feed, reads and grouping."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.functions.text import policy_thresholds
from socialspark.operators.jobs import latest_scores
from socialspark.operators.latest import earliest_follow_only, latest, top_per_key

PLAIN_MARKERS = ("", "root", "reply")


def feed(candidates: DataFrame, events: DataFrame, tags: DataFrame, scores: DataFrame, start: Column, end: Column) -> DataFrame:
    """Notifications of candidates in [start, end), with what reads need and no bodies.

    viewer, created_at, event_id, reason, actor_pubkey, event_pubkey, event_kind, is_reply,
    direct_parent_author, replies_viewer_thread, actor_score. Everything below is bounded to the window first.
    """
    inside = (F.col("created_at") >= start) & (F.col("created_at") < end)
    c = candidates.where(inside).repartition("event_id").dropDuplicates(["viewer", "event_id", "reason"])
    # What a reference needs of its target is looked up once; from there on all lies by event, and candidates are not dealt out again.
    authors = events.select(F.col("id").alias("tag_value"), F.col("pubkey").alias("ref_author"))
    e = tags.where(inside & (F.col("tag_key") == "e") & (F.octet_length("tag_value") == 64)).select("event_id", "tag_value", "tag_index", "marker").join(authors, "tag_value", "left")
    pick = lambda f, m: f(F.when(F.col("marker") == m, F.struct("ref_author")), F.when(F.col("marker") == m, F.col("tag_index")))
    plain = F.col("marker").isin(*PLAIN_MARKERS)
    meta = e.groupBy("event_id").agg((F.count_if(plain) > 0).alias("is_reply"), F.coalesce(pick(F.min_by, "reply"), pick(F.max_by, ""), pick(F.min_by, "root"))["ref_author"].alias("direct_parent_author"), F.collect_set(F.when(plain, F.col("ref_author"))).alias("thread_authors"))
    s = latest_scores(scores).select(F.col("pubkey").alias("actor_pubkey"), F.col("score").alias("actor_score"))
    body = events.where(inside).select(F.col("id").alias("event_id"), F.col("pubkey").alias("event_pubkey"), F.col("kind").alias("event_kind"))
    out = c.join(body, "event_id").join(meta, "event_id", "left").withColumn("replies_viewer_thread", F.array_contains("thread_authors", F.col("viewer"))).drop("thread_authors").join(s, "actor_pubkey", "left")
    false = F.lit(False)
    return out.select("viewer", "created_at", "event_id", "reason", "actor_pubkey", "event_pubkey", "event_kind", F.coalesce("is_reply", false).alias("is_reply"),
                      F.coalesce("direct_parent_author", F.lit("")).alias("direct_parent_author"), F.coalesce("replies_viewer_thread", false).alias("replies_viewer_thread"), F.coalesce("actor_score", F.lit(0.0)).alias("actor_score"))


@dataclass(frozen=True)
class FeedCursors:
    """How far the feed is built: up to ``head``, and back to ``edge``."""

    head: datetime | None = None
    edge: datetime | None = None


def feed_slices(c: FeedCursors, now: datetime, slice_: timedelta = timedelta(hours=1), overlap: timedelta = timedelta(minutes=10), history: timedelta = timedelta(days=14)) -> tuple[list[tuple[datetime, datetime]], FeedCursors]:
    """The windows of one tick and the cursors after it: [head - overlap, now) (one slice at first), then one slice of history, newest first, until it reaches back ``history``."""
    start = c.head - overlap if c.head else now - slice_
    windows, target = [(start, now)], now - history
    edge = c.edge or c.head or start
    if edge > target:
        windows.append((max(edge - slice_, target), edge))
        edge = windows[-1][0]
    return windows, FeedCursors(now, edge)


def walk_feed(build: Callable[[datetime, datetime], DataFrame], base: str, c: FeedCursors, now: datetime, **sizes: timedelta) -> FeedCursors:
    """One tick: write ``build(start, end)`` of each window under ``base``, replacing what an aborted tick left; cursors move only after both."""
    windows, after = feed_slices(c, now, **sizes)
    for k, (start, end) in enumerate(windows):
        build(start, end).withColumn("computed_at", F.lit(now.isoformat(" ")).cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{base}/tick={now:%Y%m%dT%H%M%S}/slice={k}")
    return after


def built_feed(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The rows of all slices; of a row built twice, the newest build."""
    rows = spark.read.option("basePath", base).schema(f"{schema}, computed_at timestamp_ntz").parquet(f"{base}/tick=*/slice=*").drop("tick", "slice")
    return latest(rows, ["viewer", "event_id", "reason"], [F.desc("computed_at")]).drop("computed_at")


@dataclass(frozen=True)
class NotificationQuery:
    tab: str = "ALL"
    policy: str = "STRICT"
    reply_scope: str = "THREAD"
    reasons: tuple[str, ...] = ()
    exclude_reasons: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    limit: int = 50
    least_window: int = 200


def read(rows: DataFrame, q: NotificationQuery, follows: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """The page of every viewer at once: a window of its newest rows, then the follow, scope and policy filters."""
    if q.tab == "MENTIONS":
        rows = rows.where("reason = 'mention'")
    if q.since:
        rows = rows.where(F.col("created_at") >= F.lit(q.since).cast("timestamp_ntz"))
    if q.until:
        rows = rows.where(F.col("created_at") < F.lit(q.until).cast("timestamp_ntz"))
    if q.reasons:
        rows = rows.where(F.col("reason").isin(*q.reasons))
    if q.exclude_reasons:
        rows = rows.where(~F.col("reason").isin(*q.exclude_reasons))
    if q.policy == "FOLLOWS":
        rows = rows.join(follows.select(F.col("follower").alias("viewer"), F.col("followed").alias("actor_pubkey")), ["viewer", "actor_pubkey"], "left_semi")
    newest = [F.desc("created_at"), F.desc("event_id"), F.asc("reason")]
    window = top_per_key(rows.dropDuplicates(["viewer", "event_id", "reason"]), ["viewer"], newest, max(8 * q.limit, q.least_window))
    out = earliest_follow_only(window)
    if q.reply_scope == "DIRECT":
        out = out.where("event_kind <> 1 OR NOT is_reply OR direct_parent_author = viewer")
    elif q.reply_scope == "THREAD":
        out = out.where("event_kind <> 1 OR NOT is_reply OR replies_viewer_thread")
    actor, viewer = policy_thresholds(q.policy)
    if actor > 0 or viewer > 0:
        own = latest_scores(scores).where(F.col("score") >= viewer).select(F.col("pubkey").alias("viewer")).withColumn("_known", F.lit(True))
        out = out.join(own, "viewer", "left").where(F.col("_known").isNotNull() | (F.col("actor_score") >= actor)).drop("_known")
    return top_per_key(out, ["viewer"], newest, q.limit, name="position")


def grouped(rows: DataFrame, first_ref: DataFrame, follower_counts: DataFrame, policy: str = "STRICT", limit: int = 50) -> DataFrame:
    """Rows collapsed to items: follows to one, reposts, reactions and zaps by target, texts alone.

    viewer, item, reason, event_id (newest), total, actors (three newest distinct), is_group, position.
    """
    target = F.when(F.col("reason").isin("repost", "reaction", "zap"), F.coalesce("target_id", F.lit("")))
    item = (F.when(F.col("reason") == "follow", "follow").when(target.isNotNull(), F.concat("reason", F.lit(":"), F.when(target == "", "profile").otherwise(target))).otherwise(F.concat(F.lit("single:"), "event_id")))
    r = rows.join(first_ref, "event_id", "left").withColumn("item", item)
    newest = F.struct("created_at", "event_id")
    # Each actor's newest row of an item first, so that an item's actors are a bounded top three.
    per_actor = r.groupBy("viewer", "item", "reason", "actor_pubkey").agg(F.count("*").alias("n"), F.max(newest).alias("at"))
    actors = top_per_key(per_actor, ["viewer", "item"], [F.desc("at"), F.asc("actor_pubkey")], 3, name="k")
    actors = actors.groupBy("viewer", "item").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "actor_pubkey"))), lambda x: x["actor_pubkey"]).alias("actors"))
    items = per_actor.groupBy("viewer", "item", "reason").agg(F.sum("n").alias("n"), F.max("at").alias("at")).join(actors, ["viewer", "item"])
    items = items.join(follower_counts.select(F.col("pubkey").alias("viewer"), "followers"), "viewer", "left")
    groupable = F.col("reason").isin("follow", "repost", "reaction", "zap") & (F.col("n") >= 2)
    total = F.when((F.col("reason") == "follow") & F.lit(policy != "FOLLOWS"), F.coalesce("followers", F.lit(0))).otherwise(F.col("n"))
    out = items.select("viewer", "item", "reason", F.col("at.created_at").alias("created_at"), F.col("at.event_id").alias("event_id"), groupable.alias("is_group"), F.when(groupable, total).otherwise(F.lit(1)).cast("long").alias("total"), F.when(groupable, F.concat_ws(",", "actors")).otherwise(F.lit("")).alias("actors"))
    return top_per_key(out, ["viewer"], [F.desc("created_at"), F.desc("event_id"), F.asc("item")], limit, name="position")
