"""Materialised tables: counters, edges, contacts, statistics, features."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.functions.tags import address, refs
from socialspark.operators.latest import latest, top_per_key

REFERENCE = "tag_key = 'e' AND octet_length(tag_value) = 64"


def distinct_per_target(tags: DataFrame, condition: str, what: str, name: str, sketch: bool = False) -> DataFrame:
    """(target_event_id, name): distinct ``what`` over tag rows; ``sketch`` gives a mergeable HLL state instead."""
    agg = F.hll_sketch_agg(what) if sketch else F.count_distinct(what)
    return tags.where(condition).groupBy(F.col("tag_value").alias("target_event_id")).agg(agg.alias(name))


def like_counts(tags: DataFrame, sketch: bool = False) -> DataFrame:
    return distinct_per_target(tags, f"kind = 7 AND {REFERENCE}", "pubkey", "likes", sketch)


def repost_counts(tags: DataFrame, sketch: bool = False) -> DataFrame:
    return distinct_per_target(tags, f"kind IN (6, 16) AND {REFERENCE}", "pubkey", "reposts", sketch)


def quote_counts(tags: DataFrame) -> DataFrame:
    return distinct_per_target(tags, "kind = 1 AND tag_key = 'q' AND octet_length(tag_value) = 64", "event_id", "quotes")


def merged_counts(states: list[DataFrame], name: str) -> DataFrame:
    """One estimate per target from the sketch states of several batches."""
    return reduce(DataFrame.unionByName, states).groupBy("target_event_id").agg(F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name))


def post_counts(events: DataFrame) -> DataFrame:
    return events.where("kind IN (1, 1111)").groupBy("pubkey").agg(F.count_distinct("id").alias("posts"))


def zap_totals(zaps: DataFrame) -> DataFrame:
    """(target_event_id, sats, zaps), each receipt once."""
    return zaps.dropDuplicates(["zap_receipt_id"]).groupBy("target_event_id").agg(F.sum("sats").alias("sats"), F.count("*").alias("zaps"))


def _parent() -> tuple[Column, Column]:
    e = (F.col("tag_key") == "e")
    pick = lambda f, m: f(F.when(e & (F.col("marker") == m), F.col("tag_value")), F.when(e & (F.col("marker") == m), F.col("tag_index")))
    return F.coalesce(pick(F.min_by, "reply"), pick(F.max_by, ""), pick(F.min_by, "root")), F.collect_set(F.when(F.col("tag_key") == "q", F.col("tag_value")))


def reply_edges(tags: DataFrame) -> DataFrame:
    """(child_id, parent_id, child_pubkey, kind, created_at): one direct parent per reply; a quoted parent is no parent."""
    parent, quotes = _parent()
    rows = tags.where("kind IN (1, 1111) AND tag_key IN ('e', 'q') AND octet_length(tag_value) = 64")
    g = rows.groupBy(F.col("event_id").alias("child_id")).agg(F.first("pubkey").alias("child_pubkey"), F.first("kind").alias("kind"), F.first("created_at").alias("created_at"), parent.alias("parent_id"), quotes.alias("_q"))
    return g.where("parent_id IS NOT NULL").where(~F.array_contains("_q", F.col("parent_id"))).select("child_id", "parent_id", "child_pubkey", "kind", "created_at")


def direct_reply_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("parent_id").alias("target_event_id")).agg(F.count_distinct("child_id").alias("replies"))


def contacts_latest(events: DataFrame) -> DataFrame:
    """(pubkey, event_id, created_at, contacts): the newest list's 64-byte keys, in order, repeats kept."""
    newest = latest(events.where("kind = 3"), ["pubkey"], [F.desc("created_at"), F.desc("id")])
    return newest.select("pubkey", F.col("id").alias("event_id"), "created_at", refs(F.col("tags"), "p").alias("contacts"))


def follow_edges(contacts: DataFrame) -> DataFrame:
    return contacts.select(F.col("pubkey").alias("follower"), F.explode("contacts").alias("followed")).distinct()


def follower_counts(contacts: DataFrame) -> DataFrame:
    return contacts.select(F.explode("contacts").alias("pubkey")).groupBy("pubkey").agg(F.count("*").alias("followers"))


def user_stats(contacts: DataFrame, posts: DataFrame, profiles: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """(pubkey, following, followers, posts) of everyone with a list, a follower, a post or a profile (or of ``touched`` ones).

    The population and the counters are one union, so there is one shuffle instead of a join each.
    """
    none = F.lit(0).cast("long")
    part = lambda df, following, followers, n: df.select("pubkey", following.alias("following"), followers.alias("followers"), n.alias("posts"))
    rows = part(contacts, F.size("contacts").cast("long"), none, none)
    rows = rows.unionByName(part(contacts.select(F.explode("contacts").alias("pubkey")), none, F.lit(1).cast("long"), none))
    rows = rows.unionByName(part(posts, none, none, F.col("posts"))).unionByName(part(profiles, none, none, none))
    if touched is not None:
        rows = rows.join(touched.select("pubkey").distinct(), "pubkey", "left_semi")
    return rows.groupBy("pubkey").agg(F.sum("following").alias("following"), F.sum("followers").alias("followers"), F.sum("posts").alias("posts"))


def scored_actors(scores: DataFrame, min_score: float, source: str = "reputation") -> DataFrame:
    return latest_scores(scores, source).where(F.col("score") >= min_score).select("pubkey")


def engaged_targets(tags: DataFrame, zaps: DataFrame, since: Column, limit: int | None = None) -> DataFrame:
    """(event_id, engaged_at): targets with an engagement since; a ``limit``, the work bound of a tick, takes the most recent."""
    a = tags.where(f"{REFERENCE} AND kind IN (1, 6, 7, 16, 1111)").select(F.col("tag_value").alias("event_id"), "created_at")
    both = a.unionByName(zaps.select(F.col("target_event_id").alias("event_id"), "created_at"))
    out = both.where(F.col("created_at") >= since).groupBy("event_id").agg(F.max("created_at").alias("engaged_at"))
    return out.orderBy(F.desc("engaged_at"), "event_id").limit(limit) if limit else out


def engagement_real(targets: DataFrame, tags: DataFrame, zaps: DataFrame, edges: DataFrame, events: DataFrame, scores: DataFrame, min_score: float = 50.0, version: str = "v1") -> DataFrame:
    """Counters of a target by distinct reputable actors; the target's author does not count, save in zaps and sats.

    All kinds of engagement are one table of (target, actor, type). It is folded to one row of flags for each target and
    actor, then to sums for each target, both with partial aggregation, so a viral target spreads; the author's own flags are
    one row to take off.
    """
    act = lambda df, target, actor, what, sats="cast(0 as bigint)": df.selectExpr(f"{target} AS event_id", f"{actor} AS actor", f"'{what}' AS what", f"{sats} AS sats")
    rows = act(tags.where(f"kind = 7 AND {REFERENCE}"), "tag_value", "pubkey", "likes")
    for more in (
        act(tags.where(f"kind IN (6, 16) AND {REFERENCE}"), "tag_value", "pubkey", "reposts"), act(edges, "parent_id", "child_pubkey", "replies"),
        act(tags.where("kind = 1 AND tag_key = 'q' AND octet_length(tag_value) = 64"), "tag_value", "pubkey", "quotes"), act(zaps, "target_event_id", "pubkey", "zaps", "sats"),
    ):
        rows = rows.unionByName(more)
    names = ("likes", "reposts", "replies", "quotes", "zaps")
    rows = rows.join(scored_actors(scores, min_score), F.col("actor") == F.col("pubkey"), "left_semi")
    flags = rows.groupBy("event_id", "actor").agg(*[F.max(F.when(F.col("what") == n, 1).otherwise(0)).cast("long").alias(n) for n in names], F.sum("sats").alias("sats"))
    totals = flags.groupBy("event_id").agg(*[F.sum(n).alias(n) for n in names], F.sum("sats").alias("sats"), F.count("*").alias("actors"))
    authors = targets.select("event_id").join(events.select(F.col("id").alias("event_id"), F.col("pubkey").alias("author")), "event_id")
    own = authors.join(flags.withColumnRenamed("actor", "author"), ["event_id", "author"]).select("event_id", *[F.col(n).alias(f"own_{n}") for n in names], F.lit(1).cast("long").alias("own_actors"))
    out = authors.join(totals, "event_id", "left").join(own, "event_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    others = [(zero(n) - zero(f"own_{n}")).alias(f"real_{n}") for n in ("likes", "reposts", "replies", "quotes")]
    return out.select("event_id", *others, zero("zaps").alias("real_zaps"), zero("sats").alias("real_zap_sats"), (zero("actors") - zero("own_actors")).alias("real_actors"), F.lit(version).alias("threshold_version"))


def note_stats(ids: DataFrame, tags: DataFrame, zaps: DataFrame, edges: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """(event_id, likes, reposts, replies, zaps, sats, quotes[, real_*]) of each id, missing ones 0."""
    out = ids.select(F.col("id").alias("event_id")).distinct()
    for counter in (like_counts(tags), repost_counts(tags), direct_reply_counts(edges), quote_counts(tags), zap_totals(zaps)):
        out = out.join(counter.withColumnRenamed("target_event_id", "event_id"), "event_id", "left")
    names = ["likes", "reposts", "replies", "quotes", "zaps", "sats"]
    if real is not None:
        names += ["real_likes", "real_actors"]
        out = out.join(real.select("event_id", "real_likes", "real_actors"), "event_id", "left")
    return out.select("event_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def latest_scores(scores: DataFrame, source: str = "reputation") -> DataFrame:
    """The newest score of each author, by partial aggregation."""
    newest = scores.where(F.col("source") == source).groupBy("pubkey").agg(F.max_by(F.struct(*scores.columns), F.struct("fetched_at", "score")).alias("s"))
    return newest.select("s.*")


def rank_features(real: DataFrame, stats: DataFrame, events: DataFrame, scores: DataFrame, users: DataFrame, metrics: DataFrame) -> DataFrame:
    """The wide feature row of each target."""
    e = events.select(F.col("id").alias("event_id"), "pubkey", "kind", "created_at")
    s = latest_scores(scores).select("pubkey", F.col("score").alias("author_score"))
    q = metrics.where("metric = 'contribution_quality'").select("event_id", F.col("value").alias("contribution_quality"))
    out = real.join(e, "event_id").join(stats.select("event_id", "likes", "reposts", "replies", "quotes", "zaps", "sats"), "event_id", "left").join(q, "event_id", "left")
    out = out.join(s, "pubkey", "left").join(users.select("pubkey", F.col("followers").alias("author_followers")), "pubkey", "left")
    raw = [F.coalesce(c, F.lit(0)).cast("long").alias(f"raw_{c}") for c in ("likes", "reposts", "replies", "quotes", "zaps", "sats")]
    return out.select("event_id", "pubkey", "kind", "created_at", *raw, *[c for c in real.columns if c.startswith("real_")],
                      F.coalesce("author_score", F.lit(0.0)).alias("author_score"), F.coalesce("author_followers", F.lit(0)).cast("long").alias("author_followers"), F.coalesce("contribution_quality", F.lit(0.0)).alias("contribution_quality"))


def notification_rows(tags: DataFrame) -> DataFrame:
    """(viewer, event_id, actor_pubkey, created_at, kind, reason) by the people an event names, without its author; a person named twice twice."""
    reason = F.when(F.col("kind") == 3, "follow").when(F.col("kind").isin(6, 16), "repost").when(F.col("kind") == 7, "reaction").when(F.col("kind") == 9735, "zap").otherwise("mention")
    rows = tags.where("tag_key = 'p' AND octet_length(tag_value) = 64 AND kind IN (1, 3, 6, 7, 16, 9735) AND tag_value <> pubkey")
    return rows.select(F.col("tag_value").alias("viewer"), "event_id", F.col("pubkey").alias("actor_pubkey"), "created_at", "kind", reason.alias("reason"))


def notification_candidates(tags: DataFrame) -> DataFrame:
    """The notification rows, each viewer, event and reason once."""
    return notification_rows(tags).dropDuplicates(["viewer", "event_id", "reason"])


def addressable_latest(events: DataFrame) -> DataFrame:
    """Newest event of each address."""
    a = events.withColumn("address", address(F.col("kind"), F.col("pubkey"), F.col("tags"))).where("address IS NOT NULL")
    return latest(a, ["address"], [F.desc("created_at"), F.desc("id")])


def viewer_sightings(requests: DataFrame, as_of: Column) -> DataFrame:
    """(pubkey, last_seen) within a year, from (pubkey, seen_at)."""
    last = requests.groupBy("pubkey").agg(F.max("seen_at").alias("last_seen"))
    return last.where(F.col("last_seen") > as_of - F.expr("INTERVAL 365 DAYS"))


def exempt_authors(viewers: DataFrame | None, contacts: DataFrame, authors: DataFrame) -> DataFrame:
    """Known viewers and everyone on their newest lists; all authors while no viewer table was loaded."""
    if viewers is None:
        return authors.select("pubkey").distinct()
    lists = contacts.join(viewers.select("pubkey").distinct(), "pubkey", "left_semi").select(F.explode("contacts").alias("pubkey"))
    return viewers.select("pubkey").unionByName(lists).distinct()


def stale_authors(events: DataFrame, contacts: DataFrame, scores: DataFrame, as_of: Column, min_followers: int, limit: int) -> DataFrame:
    """Authors active within 30 days with enough followers whose score is over 6 hours old or missing."""
    active = events.where(F.col("created_at") >= as_of - F.expr("INTERVAL 30 DAYS")).select("pubkey").distinct()
    followed = follower_counts(contacts).where(F.col("followers") >= min_followers)
    s = scores.groupBy("pubkey").agg(F.max("fetched_at").alias("fetched_at"))
    j = active.join(followed, "pubkey").join(s, "pubkey", "left")
    return j.where(F.col("fetched_at").isNull() | (F.col("fetched_at") < as_of - F.expr("INTERVAL 6 HOURS"))).orderBy(F.desc("followers"), "pubkey").limit(limit).select("pubkey", "followers", "fetched_at")


def newest_children(edges: DataFrame, n: int = 5000) -> DataFrame:
    return top_per_key(edges, ["parent_id"], [F.desc("created_at"), F.desc("child_id")], n, name="position").select("parent_id", "child_id", "position")


def run_stages(spark: SparkSession, stages: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], base: str) -> dict[str, DataFrame]:
    """One roll-up tick: each stage gets the tables of those before it and its own is written; the first that fails ends the tick.

    A failed tick leaves the tables of its earlier stages under ``base`` and raises, so that the next one starts over cleanly.
    """
    done: dict[str, DataFrame] = {}
    for name, stage in stages.items():
        df = stage(done)
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        done[name] = spark.read.schema(schema).parquet(f"{base}/{name}")
    return done
