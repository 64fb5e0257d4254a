"""Declarative retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.functions.tags import first_value
from socialspark.operators.latest import latest

LATEST_PER_AUTHOR, LATEST_PER_ADDRESS = (0, 3, 10050, 10051), (30078, 38000)
MIN_MATCHED = 50_000
#: Days each derived table keeps.
LIFETIMES = {"features": 3, "feed": 14, "candidates": 45, "viewers": 365}


def prune_kinds(events: DataFrame, kinds: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(survivors, removed per kind)."""
    keep = F.col("kind").isin(*kinds)
    return events.where(keep), events.where(~keep).groupBy("kind").agg(F.count("*").alias("removed"))


def cascade(rows: DataFrame, survivors: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Rows of a dependent table whose event survives."""
    return rows.join(survivors.select(F.col("id").alias(id_column)), id_column, "left_semi")


def keep_latest(events: DataFrame, kinds: tuple[int, ...] = LATEST_PER_AUTHOR, per_address: bool = False) -> DataFrame:
    """Only the newest event of the given kinds per author (and d value); other kinds untouched."""
    scoped = events.where(F.col("kind").isin(*kinds)).withColumn("_d", F.coalesce(first_value(F.col("tags"), "d"), F.lit("")) if per_address else F.lit(""))
    newest = latest(scoped, ["kind", "pubkey", "_d"], [F.desc("created_at"), F.desc("id")]).drop("_d")
    return newest.unionByName(events.where(~F.col("kind").isin(*kinds)))


def drop_silent_posts(events: DataFrame, counters: list[DataFrame], as_of: Column, days: int = 365) -> DataFrame:
    """Without notes older than ``days`` that were never liked, reposted, quoted, zapped or answered."""
    engaged = reduce(DataFrame.unionByName, [c.select(F.col("target_event_id").alias("id")) for c in counters]).distinct()
    old = F.coalesce((F.col("kind") == 1) & (F.col("created_at") < as_of - F.expr(f"INTERVAL {days} DAYS")), F.lit(False))
    return events.where(~old).unionByName(events.where(old).join(engaged, "id", "left_semi"))  # only old notes move


def report(before: DataFrame, rules: dict[str, DataFrame], min_matched: int = MIN_MATCHED) -> DataFrame:
    """(rule, matched, acts): how many rows each rule would remove, and whether that is enough to act."""
    spark = before.sparkSession
    total = before.agg(F.count("*").alias("n"))
    rows = [after.agg(F.count("*").alias("left")).select(F.lit(name).alias("rule"), "left") for name, after in rules.items()]
    if not rows:
        return spark.createDataFrame([], "rule string, matched long, acts boolean")
    j = reduce(DataFrame.unionByName, rows).crossJoin(total)  # one row on each side
    return j.select("rule", (F.col("n") - F.col("left")).alias("matched"), ((F.col("n") - F.col("left")) >= min_matched).alias("acts"))


def alive(rows: DataFrame, table: str, as_of: Column, column: str = "computed_at") -> DataFrame:
    """Rows of a derived table within its lifetime."""
    return rows.where(F.col(column) > as_of - F.expr(f"INTERVAL {LIFETIMES[table]} DAYS"))
