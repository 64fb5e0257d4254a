"""Queries whose work is a running stream or a change of stored tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.operators import incremental, jobs, layout, retention, stored
from socialspark.plans.backfill import _EV2, _TG2, _batches, _ended, _frames, _pieces, _stream, in_time, query_of as _query_of
from socialspark.plans.social import _SILENT
from socialspark.sources.scratch import new_path
from socialspark.streaming import annotations, intake, resume, states
from socialspark.streaming import ingest as st

Q, SQL = {}, {}


def query_of(name: str, oracle: str | None = None, *more: tuple[str, str]):
    return _query_of(name, oracle, *more, into=(Q, SQL))


#: Where the two halves of an interrupted run meet.
_HALF = "as_of - INTERVAL 10 DAY"


def _half(t):
    return F.col("ingest_ts") < (t.as_of - F.expr("INTERVAL 10 DAYS")).cast("timestamp")


_CAP_ROW = "id string, pubkey string, kind int, ingest_ts timestamp"
_FREE = "CASE WHEN created_at < {half} THEN pubkey IN (SELECT pubkey FROM ls WHERE score >= 90) ELSE pubkey IN (SELECT pubkey FROM ls WHERE score < 20) END".format(half=_HALF)


@query_of(
    "st4_st5_running_cap",
    "SELECT id FROM w WHERE NOT counts OR r <= 2",
    ("w", f"SELECT id, counts, row_number() OVER (PARTITION BY pubkey, CAST(created_at AS DATE), counts ORDER BY created_at, id) AS r FROM (SELECT id, pubkey, created_at, kind IN (1, 6, 16, 1111) AND NOT ({_FREE}) AS counts FROM ev, bnd WHERE event_id % 50 < 48)"),
)
def _(t):
    """The exempt table gets a second version in the middle of a day; both queries stop there and go on from their checkpoints."""
    base = new_path(t.spark, "capped-intake")
    frames = _frames(t).where("relay = 'wss://a'")
    exemption = intake.RefreshedExemption(lambda: intake.newest_version(t.spark, f"{base}/exempt"), every=0)
    events = st.valid_events(st.read_folder(t.spark, f"{base}/in/*", 4)).select("id", "pubkey", "kind", "ingest_ts")
    versions = [jobs.scored_actors(t.scores, 90), jobs.latest_scores(t.scores).where("score < 20")]
    for n, (authors, part) in enumerate(zip(versions, (frames.where(_half(t)), frames.where(~_half(t))), strict=True)):
        intake.publish(authors, f"{base}/exempt", n)
        st.write_folder(part, f"{base}/in/part={n}")
        st.in_file_order(t.spark, f"{base}/in/part={n}")
        _ended(intake.start_split(events, base, exemption, once=True))
        _ended(intake.start_counting(t.spark, base, _CAP_ROW, 2, once=True))
    return intake.read_intake(t.spark, base, _CAP_ROW).select("id")


@query_of("st3_resumed_sightings", "SELECT id, relay FROM ev, (VALUES ('wss://a'), ('wss://b')) AS r(relay) WHERE event_id % 50 < 48")
def _(t):
    """A run stops and its checkpoint is lost; the next one starts from the relays' marks."""
    base = new_path(t.spark, "resumed")
    frames = _frames(t, ahead=True)
    for n, part in enumerate((frames.where(_half(t)), frames.where(~_half(t)))):
        resume.land(part, f"{base}/in")
        _ended(resume.start(t.spark, f"{base}/in", base, f"{base}/checkpoint-{n}"))
    return resume.stored_sightings(t.spark, base).select("id", "relay")


def _word_counts(events: pd.DataFrame) -> pd.DataFrame:
    if events["id"].str.endswith("77").any():
        raise ValueError("cannot be read")
    notes = events[events["kind"].isin((1, 1111))]
    return pd.DataFrame({"event_id": notes["id"], "metric": "words", "value": notes["content"].str.split().str.len().astype(float)})


@query_of(
    "st9_event_failures",
    "SELECT id AS event_id, CASE WHEN id LIKE '%77' THEN 'failed' WHEN kind IN (1, 1111) THEN 'metric' ELSE 'skipped' END AS outcome, CASE WHEN id NOT LIKE '%77' AND kind IN (1, 1111) THEN CAST(len(string_split(content, ' ')) AS DOUBLE) END AS value, "
    "CASE WHEN id LIKE '%77' THEN 'ValueError: cannot be read' END AS error FROM ev WHERE event_id % 50 < 48",
)
def _(t):
    def run(frames, base):
        events = st.seen_once(st.valid_events(frames).select("id", "kind", "content", "ingest_ts")).drop("ingest_ts")
        return st.micro_batches(events, f"{base}/state", once=True).foreachBatch(annotations.annotate_each(f"{base}/out", _word_counts)).start()

    return annotations.read_outcomes(t.spark, f"{_stream(t, run)}/out").select("event_id", "outcome", "value", "error")


@query_of(
    "a5_stream_hourly_counts",
    "SELECT hour, CAST(kind AS INT) AS kind, n FROM (SELECT date_trunc('hour', created_at) AS hour, kind, count(*) AS n FROM ev WHERE event_id % 50 < 48 GROUP BY ALL), (SELECT max(created_at) AS newest FROM ev WHERE event_id % 50 < 48) WHERE hour + INTERVAL 1 HOUR <= newest - INTERVAL 10 MINUTE",
)
def _(t):
    """Hours that the watermark has closed, each given once."""

    def run(frames, base):
        counts = st.hourly_counts(st.valid_events(frames.where("relay = 'wss://a'")))
        return st.micro_batches(counts, f"{base}/state", once=True).format("parquet").option("path", f"{base}/out").outputMode("append").start()

    rows = t.spark.read.schema("hour timestamp, kind int, n long").parquet(f"{_stream(t, run, 2)}/out")
    return rows.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "kind", "n")


def _by_day(rows: DataFrame, path: str, order: list[str], dealt: bool = False) -> str:
    """``dealt``: the rows come in partitions of a few days each already."""
    by_day = rows.withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    laid = by_day if dealt else by_day.hint("rebalance", "day")
    laid.sortWithinPartitions("day", *order).write.option("compression", "zstd").partitionBy("day").parquet(path)
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in by_day.schema)


_KEPT_KINDS = (0, 1, 3, 6, 7, 1111, 9735, 30078)


@query_of(
    "rt_stored_log",
    f"SELECT id, strftime(created_at, '%Y-%m-%d') AS day FROM k3, bnd WHERE NOT ({_SILENT})",
    ("k1", f"SELECT *, row_number() OVER (PARTITION BY kind, pubkey ORDER BY created_at DESC, id DESC) AS r FROM ev WHERE kind IN {_KEPT_KINDS}"),
    ("k2", "SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY kind, pubkey, tags[1][2] ORDER BY created_at DESC, id DESC) AS r FROM k1 WHERE kind NOT IN (0, 3) OR r = 1"),
    ("k3", "SELECT * FROM k2 WHERE kind <> 30078 OR r = 1"),
)
def _(t):
    """All retention rules, one after another, on a stored event log; days that lose nothing keep their files."""
    path = f"{new_path(t.spark, 'stored-log')}/events"
    schema = _by_day(t.canonical(in_time(t)).drop("event_id", "user_id"), path, ["kind", "created_at", "pubkey", "id"], dealt=True)
    counters = [jobs.like_counts(t.tags), jobs.repost_counts(t.tags), jobs.quote_counts(t.tags), jobs.zap_totals(t.zaps), jobs.direct_reply_counts(t.edges)]
    rules = {
        "kinds": lambda log: retention.prune_kinds(log, _KEPT_KINDS)[0],
        "latest": retention.keep_latest,
        "address": lambda log: retention.keep_latest(log, retention.LATEST_PER_ADDRESS, per_address=True),
        "silent": lambda log: retention.drop_silent_posts(log, counters, t.as_of, days=10),
    }
    stored.apply_rules(t.spark, path, schema, rules, column="day")
    return stored.read_stored(t.spark, path, schema).select("id", "day")


@query_of("st12_stored_lifetimes", "SELECT 'feed' AS name, viewer, event_id FROM cand, bnd WHERE created_at > as_of - INTERVAL 14 DAY UNION ALL SELECT 'features', viewer, event_id FROM cand, bnd WHERE created_at > as_of - INTERVAL 3 DAY")
def _(t):
    """Expiry on stored tables: whole days go by folder, the day of the bound is written again."""
    rows, out = jobs.notification_candidates(t.tags).select("viewer", "event_id", "created_at"), None
    for name in ("feed", "features"):
        path = f"{new_path(t.spark, 'expiring')}/{name}"
        schema = _by_day(rows, path, ["viewer", "created_at"])
        stored.expire(t.spark, path, schema, name, t.as_of, "created_at", ["viewer", "created_at"])
        left = stored.read_stored(t.spark, path, schema).select(F.lit(name).alias("name"), "viewer", "event_id")
        out = left if out is None else out.unionByName(left)
    return out


_COUNTS = """SELECT event_id, count(DISTINCT actor) FILTER (what = 'like') AS raw_likes, count(DISTINCT actor) FILTER (what = 'repost') AS raw_reposts, count(*) FILTER (what = 'reply') AS raw_replies, count(*) FILTER (what = 'quote') AS raw_quotes,
  count(*) FILTER (what = 'zap') AS raw_zaps, CAST(sum(sats) AS BIGINT) AS raw_sats, count(DISTINCT actor) FILTER (what = 'like' AND good AND actor <> author) AS real_likes, count(DISTINCT actor) FILTER (what = 'repost' AND good AND actor <> author) AS real_reposts,
  count(DISTINCT actor) FILTER (what = 'reply' AND good AND actor <> author) AS real_replies, count(DISTINCT actor) FILTER (what = 'quote' AND good AND actor <> author) AS real_quotes, count(DISTINCT actor) FILTER (what = 'zap' AND good) AS real_zaps,
  CAST(coalesce(sum(sats) FILTER (good), 0) AS BIGINT) AS real_zap_sats, count(DISTINCT actor) FILTER (good AND actor <> author) AS real_actors FROM (SELECT a.*, n.pubkey AS author, a.actor IN (SELECT pubkey FROM ls WHERE score >= 50) AS good FROM acts a JOIN ev n ON n.id = a.event_id AND n.kind IN (1, 1111)) GROUP BY event_id"""


@query_of("st11_incremental_rollup", "SELECT c.event_id, ev.pubkey, CAST(ev.kind AS INT) AS kind, ev.created_at, c.* EXCLUDE (event_id) FROM c JOIN ev ON ev.id = c.event_id", ("c", _COUNTS))
def _(t):
    """Features after a first tick over the older events and two ticks over what came since."""
    roll = incremental.RollUp(t.spark, new_path(t.spark, "roll-up"), 16)
    log = t.events.drop("event_id", "user_id")
    for days in (3, 1, 0):
        roll.tick(log.where(F.col("created_at") <= t.as_of - F.expr(f"INTERVAL {days} DAYS")), t.scores)
    return roll.features()


@query_of(
    "st7_state_counts",
    "SELECT target_event_id, coalesce(likes, 0) AS likes, coalesce(reposts, 0) AS reposts, coalesce(quotes, 0) AS quotes, coalesce(sats, 0) AS sats, coalesce(zaps, 0) AS zaps FROM (SELECT tag_value AS target_event_id, count(DISTINCT pubkey) FILTER (kind = 7 AND tag_key = 'e') AS likes, count(DISTINCT pubkey) FILTER (kind IN (6, 16) AND tag_key = 'e') AS reposts, count(DISTINCT event_id) FILTER (kind = 1 AND tag_key = 'q') AS quotes FROM tg2 "
    "WHERE strlen(tag_value) = 64 AND (kind IN (6, 7, 16) AND tag_key = 'e' OR kind = 1 AND tag_key = 'q') GROUP BY 1) FULL JOIN (SELECT target_event_id, CAST(sum(sats) AS BIGINT) AS sats, count(*) AS zaps FROM zaps WHERE zap_receipt_id IN (SELECT id FROM ev2) GROUP BY 1) USING (target_event_id)",
    _EV2, _TG2,
)
def _(t):
    """Counts from sketches and sums that batches leave; exact while a target has few actors, else within the sketch's error."""

    def run(frames, base):
        events = st.seen_once(st.valid_events(frames).select("id", "pubkey", "kind", "created_at", "tags", "content", "ingest_ts")).drop("ingest_ts")
        return st.micro_batches(events, f"{base}/state", once=True).foreachBatch(states.keep_states(f"{base}/out", 3)).start()

    return states.counts(states.read_states(t.spark, f"{_stream(t, run, batches=_batches(t), pieces=_pieces(t))}/out"))


def _bucketed(t):
    return layout.bucketed(t.tags, "tags_by_event", "event_id", 16), layout.bucketed(t.events.select("id", "kind", "content"), "events_by_id", "id", 16)


@query_of("j1_bucketed", "SELECT tg.event_id, tag_key, tag_value, content FROM tg JOIN ev ON ev.id = tg.event_id WHERE tag_key IN ('q', 'd')")
def _(t):
    tags, events = _bucketed(t)
    return layout.hydrated(tags.where("tag_key IN ('q', 'd')"), events, "content").select("event_id", "tag_key", "tag_value", "content")


@query_of("j2_bucketed", "SELECT tg.event_id, tag_value AS target_id, s.content AS source_content, t.content AS target_content FROM tg JOIN ev s ON s.id = tg.event_id JOIN ev t ON t.id = tag_value WHERE tag_key = 'e' AND t.kind = 1 AND tg.kind = 7")
def _(t):
    tags, events = _bucketed(t)
    rows = layout.both_sides(tags.where("tag_key = 'e' AND kind = 7"), events, "content")
    return rows.where("target_kind = 1").select("event_id", "target_id", "source_content", "target_content")
