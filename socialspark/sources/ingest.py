"""From relay frames to canonical event tables."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from socialspark.functions.tags import first_value, refs, slot
from socialspark.functions.text import bolt11_sats, uint_or_zero
from socialspark.operators.latest import latest

EVENT = "id string, pubkey string, created_at bigint, kind int, tags array<array<string>>, content string, sig string"
MAX_TAGS, MAX_CONTENT = 50_000, 1_000_000
PROFILE_FIELDS = ("name", "display_name", "picture", "about", "nip05", "lud16", "lud06", "banner", "website")


def decode_frames(frames: DataFrame, value: str = "value") -> DataFrame:
    """Events of ``["EVENT", subscription, {...}]`` lines; other frames and malformed lines give nothing."""
    # a generator's columns are not put in place of their uses, so that a line is parsed once, not once for each condition on it
    event = lambda parts: F.when(F.get(parts, F.lit(0)) == "EVENT", F.from_json(F.get(parts, F.lit(2)), EVENT))
    others = [c for c in frames.columns if c != value]
    decoded = frames.select(*others, F.inline(F.transform(F.array(F.from_json(F.col(value), "array<string>")), event)))
    return decoded.where("id IS NOT NULL").withColumn("created_at", F.timestamp_seconds("created_at").cast("timestamp_ntz"))


def shape_problem() -> Column:
    """Why an event's shape is not acceptable; null if it is. A missing field has length 0."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return (
        F.when(size("id") != 64, "id").when(size("pubkey") != 64, "pubkey").when(size("sig") != 128, "sig")
        .when(F.size("tags") > MAX_TAGS, "tags").when(F.octet_length("content") > MAX_CONTENT, "content")
    )


def split_by_shape(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason)."""
    judged = events.withColumn("reason", shape_problem())
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


@F.pandas_udf(T.StringType())
def canonical_id(pubkey: pd.Series, created_at: pd.Series, kind: pd.Series, tags: pd.Series, content: pd.Series) -> pd.Series:
    """SHA-256 of the compact JSON array of an event's fields."""
    out = []
    for p, t, k, g, c in zip(pubkey, created_at, kind, tags, content, strict=True):
        body = json.dumps([0, p, int(t), int(k), [list(x) for x in g], c], separators=(",", ":"), ensure_ascii=False)
        out.append(hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest())
    return pd.Series(out)


def with_true_ids(events: DataFrame) -> DataFrame:
    """Events whose id is the hash of their content."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at"))
    return events.where(F.col("id") == canonical_id("pubkey", seconds, "kind", "tags", "content"))


def write_events(events: DataFrame, path: str, sightings: DataFrame | None = None, mode: str = "append") -> None:
    """The event log: tags as JSON, first and last sighting, partitioned by month, each month's rows together.

    ``sightings`` are provenance rows (event_id, first_seen_at, last_seen_at); an event without any was seen at its own
    time. Adaptive execution sizes a month's files, so a busy month spreads over as many tasks as it needs.
    """
    rows = events.withColumn("tags_json", F.to_json("tags")).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    if sightings is not None:
        seen = sightings.groupBy(F.col("event_id").alias("id")).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
        rows = rows.join(seen, "id", "left")
    else:
        rows = rows.withColumn("first_seen_at", F.lit(None).cast("timestamp_ntz")).withColumn("last_seen_at", F.lit(None).cast("timestamp_ntz"))
    rows = rows.withColumn("first_seen_at", F.coalesce("first_seen_at", "created_at")).withColumn("last_seen_at", F.coalesce("last_seen_at", "created_at"))
    rows.hint("rebalance", "month").sortWithinPartitions("kind", "created_at", "pubkey", "id").write.mode(mode).partitionBy("month").parquet(path)


def flatten_tags(events: DataFrame) -> DataFrame:
    """One row per tag with a key: event_id, pubkey, kind, created_at, tag_index, tag_key, tag_value, tag_extra, marker."""
    t = events.select(F.col("id").alias("event_id"), "pubkey", "kind", "created_at", F.posexplode("tags").alias("tag_index", "t"))
    return t.select("event_id", "pubkey", "kind", "created_at", "tag_index", slot(F.col("t"), 0).alias("tag_key"), slot(F.col("t"), 1).alias("tag_value"),
                    F.when(F.size("t") > 2, F.slice("t", F.lit(3), F.size("t"))).otherwise(F.array().cast("array<string>")).alias("tag_extra"), F.lower(slot(F.col("t"), 3)).alias("marker")).where("tag_key <> ''")


def relay_provenance(seen: DataFrame) -> DataFrame:
    """event_id, relay, first and last sighting, from (event_id, relay, seen_at)."""
    return seen.groupBy("event_id", "relay").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))


def note_zap(tags: Column) -> Column:
    """(target, sats) of a zap receipt's tags."""
    described = F.from_json(first_value(tags, "description"), "tags array<array<string>>")["tags"]
    target = F.coalesce(F.get(refs(tags), F.lit(0)), F.get(refs(described), F.lit(0)))
    msats = uint_or_zero(F.coalesce(first_value(tags, "amount"), F.lit("")))
    sats = F.when(msats > 0, F.floor(msats / 1000).cast("long")).otherwise(bolt11_sats(F.coalesce(first_value(tags, "bolt11"), F.lit(""))))
    return F.struct(target.alias("target"), sats.alias("sats"))


def note_zaps(events: DataFrame) -> DataFrame:
    """zap_receipt_id, target_event_id, pubkey, created_at, sats of zap receipts with a target."""
    zap = note_zap(F.col("tags"))
    return events.where("kind = 9735").select(F.col("id").alias("zap_receipt_id"), zap["target"].alias("target_event_id"), "pubkey", "created_at", zap["sats"].alias("sats")).where("target_event_id IS NOT NULL")


def profiles(events: DataFrame) -> DataFrame:
    """Latest profile of each author; fields that are missing or malformed are ''."""
    fields = [F.coalesce(F.get_json_object("content", f"$.{f}"), F.lit("")).alias(f) for f in PROFILE_FIELDS]
    newest = latest(events.where("kind = 0"), ["pubkey"], [F.desc("created_at"), F.desc("id")])
    return newest.select("pubkey", F.col("id").alias("event_id"), "created_at", *fields, F.col("content").alias("raw_json"))


def after_cursor(events: DataFrame, created_at: Column, event_id: Column, n: int) -> DataFrame:
    """The next ``n`` events after (created_at, id)."""
    later = (F.col("created_at") > created_at) | ((F.col("created_at") == created_at) & (F.col("id") > event_id))
    return events.where(later).orderBy("created_at", "id").limit(n)


def annotation_rows(annotations: DataFrame) -> DataFrame:
    """Metric rows of (event_id, pubkey, kind, created_at, metrics, model_version, computed_at); blank names are left out."""
    rows = annotations.select("event_id", "pubkey", "kind", "created_at", F.explode("metrics").alias("m"), "model_version", "computed_at")
    version = F.coalesce(F.nullif(F.trim("model_version"), F.lit("")), F.lit("unknown"))
    return rows.select("event_id", "pubkey", "kind", "created_at", F.trim("m.name").alias("metric"), F.col("m.value").alias("value"), version.alias("model_version"), "computed_at").where("metric <> ''")


def audit_units(audits: DataFrame, method: str = "key") -> DataFrame:
    """Audit rows with the union of units under nuts 4 and 5 and the first contact of a method."""
    nut = "struct<methods: array<struct<unit: string>>>"
    info = F.from_json("info", f"nuts map<string, {nut}>, contact array<struct<method: string, info: string>>")
    pairs = F.from_json(F.get_json_object("info", "$.contact"), "array<array<string>>")
    units = F.concat(*[F.coalesce(F.transform(F.try_element_at(info["nuts"], F.lit(k))["methods"], lambda m: F.lower(F.trim(m["unit"]))), F.array().cast("array<string>")) for k in ("4", "5")])
    named = F.get(F.filter(info["contact"], lambda c: F.lower(c["method"]) == method), F.lit(0))["info"]
    paired = F.get(F.filter(pairs, lambda c: F.lower(F.get(c, F.lit(0))) == method), F.lit(0))
    return audits.select("url", "name", "state", "n_mints", "n_melts", "n_errors", F.array_sort(F.array_distinct(F.filter(units, lambda u: u != ""))).alias("units"), F.coalesce(named, F.get(paired, F.lit(1)), F.lit("")).alias("operator"))
