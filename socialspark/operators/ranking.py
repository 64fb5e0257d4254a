"""Weighted rankings of notes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from socialspark.functions import text as tx
from socialspark.operators.aggregate import references_per_target

#: Feature column of each global term.
FEATURES = {"likes": "real_likes", "replies": "real_replies", "reposts": "real_reposts", "quotes": "real_quotes", "zap_sats": "real_zap_sats", "actors": "real_actors", "author_score": "author_score", "quality": "contribution_quality", "recency": "created_at"}
LOGARITHMIC = ("likes", "replies", "reposts", "quotes", "zap_sats")


@dataclass(frozen=True)
class Term:
    """One part of a score: references to the candidate, its author's score, a field of it, or a metric."""

    source: str  # references | author_score | field | metric
    name: str
    weight: float
    transform: str = "IDENTITY"
    half_life: float = 86_400.0
    min_followers: int = 0
    fallback: float = 0.0


@dataclass(frozen=True)
class RankSpec:
    terms: tuple[Term, ...]
    kinds: tuple[int, ...] = (1,)
    limit: int = 100
    seed: str = ""
    counter: int = 0
    strength: float = 0.15
    boosts: tuple[tuple[str, float], ...] = field(default=())


def transformed(value: Column, term: Term, as_of: Column) -> Column:
    if term.transform == "LOG1P":
        return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))
    if term.transform == "RECENCY_HALFLIFE":
        return tx.half_life(tx.unix(as_of) - tx.unix(value), term.half_life)
    return value.cast("double")


def feature_scores(features: DataFrame, weights: dict[str, float], as_of: Column, half_life: float = 86_400.0, min_followers: int = 0) -> DataFrame:
    """(event_id, pubkey, created_at, score): one pass over the feature table."""
    score = F.lit(0.0)
    for name, w in weights.items():
        c = F.col(FEATURES[name])
        if name in LOGARITHMIC:
            part = F.log(F.lit(1.0) + c)
        elif name == "author_score":
            part = F.when(F.col("author_followers") >= min_followers, c).otherwise(F.lit(0.0))
        elif name == "recency":
            part = tx.half_life(tx.unix(as_of) - tx.unix(c), half_life)
        else:
            part = c.cast("double")
        score = score + F.lit(float(w)) * part
    return features.select("event_id", "pubkey", "created_at", score.alias("score"))


def top_scores(scored: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.desc("created_at"), F.desc("event_id")).offset(offset).limit(limit)


def by_references(targets: DataFrame, tags: DataFrame, function: str = "COUNT_DISTINCT", column: str = "pubkey", kinds: tuple[int, ...] = (7,)) -> DataFrame:
    """(id, score): targets by all that references them."""
    rows = tags.where(F.col("kind").isin(*kinds))
    return references_per_target(targets, rows, newest=None, metrics=(("score", function, column),)).withColumnRenamed("target_id", "id")


def weighted_scores(candidates: DataFrame, terms: tuple[Term, ...], tags: DataFrame, scores: DataFrame, metrics: DataFrame, as_of: Column) -> DataFrame:
    """candidates (id, pubkey, created_at) with ``score``: one left join for each term, then a sum."""
    out, total = candidates, F.lit(0.0)
    for k, t in enumerate(terms):
        name = f"_t{k}"
        if t.source == "references":
            kinds = {"likes": (7,), "reposts": (6, 16), "zaps": (9735,), "replies": (1, 1111)}[t.name]
            part = by_references(candidates, tags, kinds=kinds).select("id", F.col("score").alias(name))
            out = out.join(part, "id", "left")
            value = F.coalesce(name, F.lit(0))
        elif t.source == "author_score":
            part = scores.select("pubkey", F.when(F.col("followers") >= t.min_followers, F.col("score")).alias(name))
            out = out.join(part, "pubkey", "left")
            value = F.coalesce(name, F.lit(t.fallback))
        elif t.source == "metric":
            part = metrics.where(F.col("metric") == t.name).select(F.col("event_id").alias("id"), F.col("value").alias(name))
            out = out.join(part, "id", "left")
            value = F.coalesce(name, F.lit(t.fallback))
        else:
            value = F.col(t.name)
        total = total + F.lit(float(t.weight)) * transformed(value, t, as_of)
    return out.select("id", "pubkey", "created_at", total.alias("score"))


def route(terms: tuple[Term, ...], is_global: bool) -> str:
    """``features`` if the feature table can serve the ranking, else ``live``."""
    served = {("references", "likes"), ("references", "reposts"), ("references", "replies"), ("author_score", "reputation"), ("metric", "contribution_quality"), ("field", "created_at")}
    return "features" if is_global and all((t.source, t.name) in served for t in terms) else "live"


def feature_weights(terms: tuple[Term, ...]) -> tuple[dict[str, float], float, int]:
    """(weights, half-life, least followers) by which :func:`feature_scores` serves terms that :func:`route` sends to the features."""
    names = {"reputation": "author_score", "contribution_quality": "quality", "created_at": "recency"}
    half = next((t.half_life for t in terms if t.source == "field"), 86_400.0)
    return {names.get(t.name, t.name): t.weight for t in terms}, half, max((t.min_followers for t in terms if t.source == "author_score"), default=0)


def boosted_per_viewer(scored: DataFrame, follows: DataFrame, weight: float) -> DataFrame:
    """(viewer, id, score): the rows that a viewer's follows lift, with their score; all others keep the shared one."""
    mine = follows.select(F.col("follower").alias("viewer"), F.col("followed").alias("pubkey")).distinct()
    return scored.join(mine, "pubkey").select("viewer", "id", (F.col("score") + F.lit(float(weight))).alias("score"))


def boosted(scored: DataFrame, keys: DataFrame, weight: float) -> DataFrame:
    """Add ``weight`` to rows whose author is among ``keys``."""
    flag = keys.select("pubkey").distinct().withColumn("_b", F.lit(float(weight)))
    return scored.join(flag, "pubkey", "left").withColumn("score", F.col("score") + F.coalesce("_b", F.lit(0.0))).drop("_b")


def jittered(scored: DataFrame, seed: str, counter: int, strength: float = 0.15) -> DataFrame:
    return scored.withColumn("score", F.col("score") + tx.jitter(F.col("id"), seed, counter, strength))


def per_viewer(pool: DataFrame, follows: DataFrame, weight: float, n: int) -> DataFrame:
    """(viewer, id, rank) from a pool shared by all viewers: those followed are boosted, then the best ``n`` of each viewer.

    Only a viewer's boosts (``weight`` of 0 or more) differ from the pool's order, so its best are among those and the
    pool's first n. The first n are one scalar that every row reads; the shuffle carries follow edges and boosted rows,
    of which a viewer has no more than the bounded pool has rows. Ties go to the newer row, then the greater id.
    """
    entry = lambda score: F.struct(score.cast("double").alias("score"), "created_at", "id")
    first = pool.orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")).limit(n).agg(F.collect_list(entry(F.col("score"))).alias("first")).scalar()
    rows = pool.select("pubkey", entry(F.col("score") + F.lit(float(weight))).alias("mine"))
    own = follows.select(F.col("follower").alias("viewer"), F.col("followed").alias("pubkey")).join(rows, "pubkey", "left").groupBy("viewer").agg(F.collect_set("mine").alias("mine"))
    shared = F.filter(F.col("shared"), lambda r: ~F.exists("mine", lambda m: m["id"] == r["id"]))
    best = own.withColumn("shared", first).select("viewer", F.slice(F.sort_array(F.concat("mine", shared), asc=False), 1, n).alias("best"))
    return best.select("viewer", F.posexplode("best")).select("viewer", F.col("col.id").alias("id"), (F.col("pos") + 1).alias("rank"))
