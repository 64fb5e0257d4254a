"""Latest rows, per-key limits, orders and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from socialspark.functions.text import seeded

NEWEST = ("created_at", "id")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, offset: int = 0, name: str | None = None) -> DataFrame:
    """Rows offset+1 .. offset+n of each key; the limit is applied before the shuffle too."""
    out = ranked(df, keys, order, name or "_rank").where((F.col(name or "_rank") > offset) & (F.col(name or "_rank") <= offset + n))
    return out if name else out.drop("_rank")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def newest_first(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def seeded_order(df: DataFrame, seed: str, counter: int, limit: int, lead: str = "created_at") -> DataFrame:
    """Order by a leading column, ties by a seeded hash of the id."""
    return df.withColumn("shuffle", seeded(F.col("id"), seed, counter)).orderBy(F.desc(lead), "shuffle", "id").limit(limit)


def earliest_follow_only(rows: DataFrame, viewer: str = "viewer") -> DataFrame:
    """Of follow rows the earliest per viewer and actor; other reasons untouched."""
    follows = latest(rows.where("reason = 'follow'"), [viewer, "actor_pubkey"], [F.asc("created_at"), F.asc("event_id")])
    return follows.unionByName(rows.where("reason <> 'follow'"))


def daily_cap(events: DataFrame, exempt: DataFrame, cap: int, kinds: tuple[int, ...] = (1, 6, 16, 1111)) -> DataFrame:
    """Adds ``dropped``: a capped kind beyond the author's ``cap`` of its ingest day; exempt authors never."""
    counted = events.where(F.col("kind").isin(*kinds)).join(exempt.select("pubkey").distinct(), "pubkey", "left_anti").withColumn("_day", F.to_date("ingest_ts"))
    over = ranked(counted, ["pubkey", "_day"], [F.asc("ingest_ts"), F.asc("id")], "_n").where(F.col("_n") > cap).select("id")
    return events.join(over.withColumn("dropped", F.lit(True)), "id", "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def merge_newest(frames: list[DataFrame], limit: int) -> DataFrame:
    """Union, one row per id, newest first."""
    return newest_first(reduce(DataFrame.unionByName, frames).dropDuplicates(["id"]), limit)


def first_positions(rows: DataFrame, key: list[str], value: str, position: str) -> DataFrame:
    """Ordered-unique: the first position of each value within a key."""
    return rows.groupBy(*key, value).agg(F.min(position).alias(position))


def complete_ranking(candidates: DataFrame, ranking: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Ranked ids first, then the other candidates newest first: id, position within the page's order."""
    j = candidates.join(ranking.select("id", "rank"), "id", "left")
    return j.orderBy(F.asc_nulls_last("rank"), F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def page_until(events: DataFrame, until: Column, cursor_id: str, limit: int) -> DataFrame:
    """Events at or before ``until`` without the cursor's own, with each row's cursor."""
    page = newest_first(events.where((F.col("created_at") <= until) & (F.col("id") != cursor_id)), limit)
    return page.withColumn("cursor", F.concat_ws("|", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at")).cast("string"), "id"))
