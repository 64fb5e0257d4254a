"""Mint reviews and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.functions.tags import first_value
from socialspark.functions.text import clamp, normalise_url, review_score
from socialspark.operators.latest import latest

REVIEW_KIND, MINT_K = 38000, "38172"


def mint_reviews(events: DataFrame) -> DataFrame:
    """(mint, reviewer, event_id, score, created_at): the newest review of each reviewer."""
    e = events.where((F.col("kind") == REVIEW_KIND) & (first_value(F.col("tags"), "k") == MINT_K))
    e = e.select(normalise_url(first_value(F.col("tags"), "u")).alias("mint"), F.col("pubkey").alias("reviewer"), F.col("id").alias("event_id"), review_score(F.col("content")).alias("score"), "created_at").where("mint <> ''")
    return latest(e, ["mint", "reviewer"], [F.desc("created_at"), F.desc("event_id")])


def mint_scores(reviews: DataFrame) -> DataFrame:
    """(mint, average, reviews, favourites): mean of the scored ones, count, count without a score."""
    return reviews.groupBy("mint").agg(F.avg("score").alias("average"), F.count("*").alias("reviews"), F.count_if(F.col("score").isNull()).alias("favourites"))


def leaderboard(scores: DataFrame, audits: DataFrame, followers: DataFrame) -> DataFrame:
    """Mints of reviews or audits: green ones first, then by uptime, score, number of reviews and reach."""
    a = audits.select(normalise_url(F.col("url")).alias("mint"), "state", "n_mints", "n_melts", "n_errors").dropDuplicates(["mint"])
    j = scores.join(a, "mint", "full_outer").join(followers.select("mint", F.col("followers").alias("_f")), "mint", "left")
    num = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    ok = num("n_mints") + num("n_melts")
    uptime = F.when(ok + num("n_errors") > 0, ok / (ok + num("n_errors"))).otherwise(F.lit(0.0))
    score = F.lit(0.40) * uptime + F.lit(0.30) * num("average") / F.lit(5.0) + F.lit(0.20) * clamp(F.log10(F.lit(1.0) + num("reviews")) / F.lit(2.0)) + F.lit(0.10) * clamp(F.log10(F.lit(1.0) + num("_f")) / F.lit(4.0))
    out = j.select("mint", "average", F.coalesce("reviews", F.lit(0)).cast("long").alias("reviews"), F.coalesce("favourites", F.lit(0)).cast("long").alias("favourites"),
                   F.coalesce(F.upper("state") == "OK", F.lit(False)).alias("green"), uptime.alias("uptime"), score.alias("score"))
    return out.orderBy(F.desc("green"), F.desc("score"), "mint")
