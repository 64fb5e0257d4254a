"""Allow-listed aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.functions.text import uint_or_zero
from socialspark.operators.latest import top_per_key

_TIMES = {"EVENTS": "created_at", "TAGS": "created_at", "DERIVED_TAGS": "created_at", "RELAYS": "last_seen_at"}
_PLAIN = {
    "EVENTS": {"KIND": "kind", "PUBKEY": "pubkey", "AUTHOR": "pubkey", "EVENT_ID": "id", "CONTENT": "content"},
    "TAGS": {"KIND": "kind", "PUBKEY": "pubkey", "AUTHOR": "pubkey", "EVENT_ID": "event_id", "TAG_KEY": "tag_key", "TAG_VALUE": "tag_value"},
    "RELAYS": {"RELAY": "relay", "EVENT_ID": "event_id"},
}
_PLAIN["DERIVED_TAGS"] = _PLAIN["TAGS"]
_UNIQUE = {
    "EVENTS": {"UNIQUE_EVENTS": "id", "UNIQUE_PUBKEYS": "pubkey", "UNIQUE_AUTHORS": "pubkey"},
    "TAGS": {"UNIQUE_EVENTS": "event_id", "UNIQUE_PUBKEYS": "pubkey", "UNIQUE_AUTHORS": "pubkey", "UNIQUE_TAG_VALUES": "tag_value"},
    "RELAYS": {"UNIQUE_EVENTS": "event_id", "UNIQUE_RELAYS": "relay"},
}
_UNIQUE["DERIVED_TAGS"] = _UNIQUE["TAGS"]


@dataclass(frozen=True)
class AggregateSpec:
    dataset: str
    dimensions: tuple[str, ...]
    metrics: tuple[str, ...]
    limit: int = 100


def dimension(dataset: str, name: str) -> Column:
    """Column of an allowed dimension, named in lower case."""
    time = F.col(_TIMES[dataset])
    if name == "DAY":
        return F.to_date(time).alias("day")
    if name == "HOUR":
        return F.date_trunc("hour", time).cast("timestamp_ntz").alias("hour")
    if name not in _PLAIN[dataset]:
        raise ValueError(f"{dataset} has no dimension {name}")
    return F.col(_PLAIN[dataset][name]).alias(name.lower())


def metric(dataset: str, name: str) -> Column:
    if name == "COUNT":
        return F.count("*").alias("count")
    if name not in _UNIQUE[dataset]:
        raise ValueError(f"{dataset} has no metric {name}")
    return F.count_distinct(_UNIQUE[dataset][name]).alias(name.lower())


def aggregate(rows: DataFrame, spec: AggregateSpec) -> DataFrame:
    """Group by the dimensions; most of the first metric first, then by dimensions; at most ``limit`` rows."""
    if not spec.metrics or not 0 < spec.limit <= 1000:
        raise ValueError("one metric or more, and a limit of 1 to 1000")
    metrics = [metric(spec.dataset, m) for m in spec.metrics]
    if not spec.dimensions:
        return rows.agg(*metrics)
    names = [d.lower() for d in spec.dimensions]
    out = rows.groupBy(*[dimension(spec.dataset, d) for d in spec.dimensions]).agg(*metrics)
    return out.orderBy(F.desc(spec.metrics[0].lower()), *names).limit(spec.limit)


def value_metric(name: str, value: Column) -> Column:
    """COUNT, COUNT_DISTINCT, or SUM, AVG (whole part), MIN, MAX over text read as unsigned numbers."""
    n = uint_or_zero(value)
    whole = F.floor(F.avg(n)).cast("long")
    return {"COUNT": F.count("*"), "COUNT_DISTINCT": F.count_distinct(value), "SUM": F.sum(n), "AVG": whole, "MIN": F.min(n), "MAX": F.max(n)}[name]


def references_per_target(targets: DataFrame, tags: DataFrame, key: str = "e", newest: int | None = 500, dims: tuple[str, ...] = (), metrics: tuple[tuple[str, str, str], ...] = (("n", "COUNT", "event_id"),), first: int | None = None) -> DataFrame:
    """For each target (column id) its newest referencing events (all of them, if ``newest`` is None), aggregated; ``metrics`` are (name, function, column).

    Targets without references give a row of zeros where there are no dimensions.
    """
    refs = tags.where(F.col("tag_key") == key).join(targets.select(F.col("id").alias("tag_value")), "tag_value", "left_semi").dropDuplicates(["tag_value", "event_id"])
    if newest is not None:
        refs = top_per_key(refs, ["tag_value"], [F.desc("created_at"), F.desc("event_id")], newest)
    out = refs.groupBy(F.col("tag_value").alias("target_id"), *dims).agg(*[value_metric(f, F.col(c)).alias(n) for n, f, c in metrics])
    if not dims:
        zeros = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n, _, _ in metrics]
        return targets.select(F.col("id").alias("target_id")).distinct().join(out, "target_id", "left").select("target_id", *zeros)
    if first:
        out = top_per_key(out, ["target_id"], [F.desc(metrics[0][0]), *dims], first)
    return out


def referenced_targets(tags: DataFrame, targets: DataFrame, key: str = "e") -> DataFrame:
    """Tag rows whose target is one of ``targets`` (id, pubkey, kind), with both sides."""
    t = targets.select(F.col("id").alias("tag_value"), F.col("pubkey").alias("target_pubkey"), F.col("kind").alias("target_kind"))
    return tags.where(F.col("tag_key") == key).join(t, "tag_value")


def kind_counts(events: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """Counts of the kinds asked for, absent ones as 0."""
    wanted = events.sparkSession.createDataFrame([(k,) for k in kinds], "kind int")
    found = events.where(F.col("kind").isin(*kinds)).groupBy("kind").agg(F.count("*").alias("n"))
    return wanted.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def reaction_breakdown(events: DataFrame, tags: DataFrame) -> DataFrame:
    """(target_id, reaction, n): '+' and '' are like, '-' is dislike, the rest stands for itself."""
    name = F.when(F.col("content").isin("+", ""), "like").when(F.col("content") == "-", "dislike").otherwise(F.col("content"))
    r = events.where("kind = 7").select(F.col("id").alias("event_id"), name.alias("reaction"))
    t = tags.where("kind = 7 AND tag_key = 'e'").select("event_id", F.col("tag_value").alias("target_id")).distinct()
    return r.join(t, "event_id").groupBy("target_id", "reaction").agg(F.count("*").alias("n"))


def first_event_time(keys: DataFrame, events: DataFrame) -> DataFrame:
    first = events.groupBy("pubkey").agg(F.min("created_at").alias("first_at"))
    return keys.select("pubkey").distinct().join(first, "pubkey", "left")
