"""Reply quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.functions import text as tx
from socialspark.functions.tags import is_reply
from socialspark.operators.latest import latest

# Fixed word lists.
POSITIVE = ["good", "great", "excellent", "love", "like", "useful", "helpful", "agree", "correct"]
NEGATIVE = ["bad", "terrible", "hate", "wrong", "broken", "spam", "scam", "awful", "disagree"]
REASONS = ["because", "therefore", "since", "example", "evidence", "source"]
INSULTS = ["idiot", "moron", "stupid", "shut up", "kill yourself"]
LURES = ["airdrop", "giveaway", "click here", "free money", "telegram"]
REACTIONS = ["lol", "haha", "wow", "nice", "gm", "ngmi", "lfg"]
METRICS = ("contribution_quality", "reply_relevance", "reply_informativeness", "reply_novelty", "reply_constructiveness")


def sentiment(lower: Column) -> Column:
    """(positive - negative) / (positive + negative) words present; 0 without any."""
    p, n = tx.count_present(lower, POSITIVE), tx.count_present(lower, NEGATIVE)
    return F.when(p + n > 0, (p - n) / (p + n).cast("double")).otherwise(F.lit(0.0))


def quality_columns(events: DataFrame) -> DataFrame:
    """Replies with a column for each metric."""
    df = events.where(is_reply(F.col("kind"), F.col("tags")))
    df = df.withColumn("_low", F.lower("content")).withColumn("_tok", tx.tokens(F.col("content")))
    df = df.withColumn("_n", F.size("_tok")).withColumn("_uniq", tx.variety(F.col("_tok"))).withColumn("_top", tx.top_share(F.col("_tok")))
    low, n, uniq = F.col("_low"), F.col("_n"), F.col("_uniq")
    reaction = F.when(n == 0, F.trim("content") != "").otherwise((n <= 3) & tx.contains_any(low, REACTIONS))
    times = lambda value, cond, factor: value * F.when(cond, F.lit(factor)).otherwise(F.lit(1.0))
    relevance = tx.clamp(F.lit(0.55) + F.when(n >= 4, F.lit(0.15)).otherwise(F.lit(0.0)) + F.when(tx.contains_any(low, REASONS), F.lit(0.15)).otherwise(F.lit(0.0)))
    inform = tx.clamp(tx.clamp(n.cast("double") / F.lit(36.0)) * F.lit(0.65) + uniq * F.lit(0.35))
    novelty = tx.clamp(F.lit(0.35) + uniq * F.lit(0.65))
    construct = tx.clamp(F.lit(0.65) + sentiment(low) * F.lit(0.2))
    inform, construct = times(inform, reaction, 0.25), times(construct, reaction, 0.75)
    novelty, inform = times(novelty, F.col("_top") > 0.45, 0.45), times(inform, F.col("_top") > 0.45, 0.75)
    construct = times(construct, tx.contains_any(low, INSULTS), 0.25)
    lure = tx.contains_any(low, LURES)
    inform, novelty = times(inform, lure, 0.5), times(novelty, lure, 0.6)
    parts = df.select("id", "pubkey", "kind", "created_at", relevance.alias("reply_relevance"), inform.alias("reply_informativeness"), novelty.alias("reply_novelty"), construct.alias("reply_constructiveness"))
    total = F.col("reply_relevance") * 0.25 + F.col("reply_informativeness") * 0.35 + F.col("reply_novelty") * 0.15 + F.col("reply_constructiveness") * 0.25
    return parts.withColumn("contribution_quality", tx.clamp(total))


def quality_metrics(events: DataFrame, version: str = "heuristic-v1") -> DataFrame:
    """(event_id, pubkey, kind, created_at, metric, value, model_version): five rows for each reply."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    return quality_columns(events).select(F.col("id").alias("event_id"), "pubkey", "kind", "created_at", each.alias("m")).select("event_id", "pubkey", "kind", "created_at", "m.metric", "m.value", F.lit(version).alias("model_version"))


def newest_metrics(metrics: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """(event_id, value): the newest value of a metric for the ids asked for."""
    rows = metrics.where(F.col("metric") == name).join(ids.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return latest(rows, ["event_id"], [F.desc("computed_at"), F.desc("value")]).select("event_id", "value")


def score_rows(payloads: DataFrame) -> DataFrame:
    """Score rows of (source, pubkey, payload JSON, fetched_at); payloads without a score give none."""
    p = F.from_json("payload", "score double, followers bigint, nodes bigint, rank double")
    return payloads.select("source", "pubkey", p.alias("p"), "fetched_at").where("p.score IS NOT NULL").select("source", "pubkey", "p.score", "p.followers", "p.nodes", "fetched_at")


def keyword_tags(events: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """Derived tags (event_id, pubkey, kind, created_at, tag_key, tag_value): each stated keyword among an event's tokens, once."""
    found = F.array_intersect(tx.tokens(F.col("content")), F.array(*map(F.lit, keywords)))
    return events.select(F.col("id").alias("event_id"), "pubkey", "kind", "created_at", F.lit("keyword").alias("tag_key"), F.explode(found).alias("tag_value"))
