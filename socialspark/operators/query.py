"""Generic event queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.functions.tags import TagPredicate
from socialspark.functions.text import contains_ci, is_hex64
from socialspark.operators.latest import latest, newest_first, top_per_key

MAX_LIMIT = 500
#: Key lists up to this long become a literal list; longer ones a semi-join.
LITERALS = 1000


@dataclass(frozen=True)
class TagFilter:
    key: str
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class EventQuery:
    ids: tuple[str, ...] = ()
    pubkeys: tuple[str, ...] = ()
    kinds: tuple[int, ...] = ()
    tags: tuple[TagFilter, ...] = ()
    exclude_tags: tuple[TagFilter, ...] = ()
    exclude_ids: tuple[str, ...] = ()
    exclude_pubkeys: tuple[str, ...] = ()
    search: str = ""
    since: str | None = None
    until: str | None = None
    min_followers: int | None = None
    limit: int = 50
    offset: int = 0
    sorted_seed: tuple[str, int] | None = field(default=None)

    def checked(self) -> EventQuery:
        """The bounded contract: something selective is given, and the limit is in range."""
        if not (self.ids or self.pubkeys or self.kinds or self.tags):
            raise ValueError("give at least one of ids, pubkeys, kinds or tags")
        if not 0 < self.limit <= MAX_LIMIT:
            raise ValueError(f"limit is 1 to {MAX_LIMIT}")
        return self


def in_list(df: DataFrame, column: str, values: tuple) -> DataFrame:
    if len(values) <= LITERALS:
        return df.where(F.col(column).isin(*values))
    keys = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {df.schema[column].dataType.simpleString()}")
    return df.join(keys, column, "left_semi")


def not_in_list(df: DataFrame, column: str, values: tuple) -> DataFrame:
    """Rows whose column is none of ``values``; a null is none of them."""
    if len(values) <= LITERALS:
        return df.where(F.col(column).isNull() | ~F.col(column).isin(*values))
    keys = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {df.schema[column].dataType.simpleString()}")
    return df.join(keys, column, "left_anti")


def in_keys(df: DataFrame, column: str, keys: DataFrame, key: str | None = None) -> DataFrame:
    """Rows whose column occurs in ``keys``."""
    return df.join(keys.select(F.col(key or column).alias(column)), column, "left_semi")


def not_in_keys(df: DataFrame, column: str, keys: DataFrame, key: str | None = None) -> DataFrame:
    return df.join(keys.select(F.col(key or column).alias(column)), column, "left_anti")


def between(df: DataFrame, since: str | None, until: str | None, column: str = "created_at") -> DataFrame:
    """Inclusive since, exclusive until; the time column differs by dataset."""
    if since:
        df = df.where(F.col(column) >= F.lit(since).cast("timestamp_ntz"))
    if until:
        df = df.where(F.col(column) < F.lit(until).cast("timestamp_ntz"))
    return df


def with_tag(events: DataFrame, tags: DataFrame, f: TagFilter, how: str = "left_semi", id_column: str = "id") -> DataFrame:
    """Events that have (left_semi) or lack (left_anti) a tag row; each filter looks at rows of its own."""
    t = tags.where(F.col("tag_key") == f.key)
    if f.values:
        t = in_list(t, "tag_value", f.values)
    return events.join(t.select(F.col("event_id").alias(id_column)), id_column, how)


def reputable(df: DataFrame, scores: DataFrame, n: int, source: str = "reputation") -> DataFrame:
    """Rows whose author's greatest follower count at the source is ``n`` or more."""
    known = scores.where(F.col("source") == source).groupBy("pubkey").agg(F.max("followers").alias("f")).where(F.col("f") >= n)
    return in_keys(df, "pubkey", known)


def select_events(events: DataFrame, q: EventQuery, tags: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """The query's filters without order and limit."""
    df = events
    for column, values in (("id", q.ids), ("pubkey", q.pubkeys), ("kind", q.kinds)):
        if values:
            df = in_list(df, column, values)
    df = between(df, q.since, q.until)
    if q.search:
        df = df.where(contains_ci(F.col("content"), q.search))
    for column, values in (("id", q.exclude_ids), ("pubkey", q.exclude_pubkeys)):
        if values:
            df = not_in_list(df, column, values)
    for f in q.tags:
        df = with_tag(df, tags, f)
    for f in q.exclude_tags:
        df = with_tag(df, tags, f, "left_anti")
    if q.min_followers is not None:
        df = reputable(df, scores, q.min_followers)
    return df


def event_query(events: DataFrame, q: EventQuery, tags: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Filtered events, one row per id, newest first."""
    q = q.checked()
    return newest_first(select_events(events, q, tags, scores).dropDuplicates(["id"]), q.limit, q.offset)


def by_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    return in_keys(events, "id", ids).dropDuplicates(["id"])


def latest_per_author(events: DataFrame, kinds: tuple[int, ...], n: int) -> DataFrame:
    if not 1 <= n <= 20:
        raise ValueError("1 to 20 events per author")
    return top_per_key(in_list(events, "kind", kinds), ["pubkey"], [F.desc("created_at"), F.desc("id")], n, name="rank")


def dynamic_pubkeys(events: DataFrame, kind: int, predicate: TagPredicate, newest: int = 1, max_values: int = 500) -> DataFrame:
    """(pubkey, value): hex values that a predicate finds in an author's newest list events. No value, no row: a query over it finds nothing."""
    lists = top_per_key(events.where(F.col("kind") == kind), ["pubkey"], [F.desc("created_at"), F.desc("id")], newest, name="list_rank")
    found = lists.select("pubkey", "list_rank", F.posexplode(predicate.values_of(F.col("tags"))).alias("place", "value")).where(is_hex64(F.col("value")))
    first = latest(found, ["pubkey", "value"], [F.asc("list_rank"), F.asc("place")])
    return top_per_key(first, ["pubkey"], [F.asc("list_rank"), F.asc("place")], max_values).select("pubkey", "value")


def own_references(tags: DataFrame, events: DataFrame) -> DataFrame:
    """References whose target has the same author: (event_id, target_id, pubkey)."""
    e = tags.where("tag_key = 'e'").select("event_id", F.col("tag_value").alias("target_id"), "pubkey")
    return e.join(events.select(F.col("id").alias("target_id"), "pubkey"), ["target_id", "pubkey"]).distinct()


def history(events: DataFrame, action: str) -> DataFrame:
    """An author's own events by type of action."""
    has_e = F.exists("tags", lambda t: F.coalesce(F.get(t, F.lit(0)), F.lit("")) == "e")
    rules = {
        "posts": (F.col("kind") == 1) & ~has_e, "replies": F.col("kind").isin(1, 1111) & has_e, "reposts": F.col("kind").isin(6, 16), "reactions": F.col("kind") == 7,
        "messages": F.col("kind") == 4, "lists": F.col("kind").isin(3, 10000, 10002), "zaps": F.col("kind") == 9735,
    }
    if action not in rules:
        raise ValueError(f"action is one of {', '.join(rules)}")
    return events.where(rules[action])
