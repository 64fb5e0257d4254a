"""Whole rebuilds, and the stream jobs run over the given events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.operators import enrich, jobs
from socialspark.plans.fixtures import Tables
from socialspark.plans.oracle import sql
from socialspark.plans.social import _QL
from socialspark.sources.ingest import annotation_rows, decode_frames, profiles, split_by_shape, with_true_ids, write_events
from socialspark.sources.scratch import new_path
from socialspark.streaming import ingest as st

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query_of(name: str, oracle: str | None = None, *more: tuple[str, str], into: tuple[dict, dict] = (Q, SQL)):
    def wrap(f: Callable[[Tables], DataFrame]):
        into[0][name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            into[1][name] = sql(oracle, *more)
        return f

    return wrap


def rebuild(t: Tables, base: str) -> None:
    """Every derived table from events and tags; a second run gives the same tables."""
    edges = t.edges
    contacts, posts, prof = t.contacts, jobs.post_counts(t.events), profiles(t.events)
    tables = {
        "likes": jobs.like_counts(t.tags), "reposts": jobs.repost_counts(t.tags), "quotes": jobs.quote_counts(t.tags), "zaps": t.zaps, "zap_totals": jobs.zap_totals(t.zaps), "edges": edges,
        "replies": jobs.direct_reply_counts(edges), "profiles": prof, "contacts": contacts, "posts": posts, "user_stats": jobs.user_stats(contacts, posts, prof), "candidates": jobs.notification_candidates(t.tags),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")


@query_of("s10_backfill", "SELECT 'likes' AS name, count(*) AS n FROM lk UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'zaps', count(*) FROM zaps UNION ALL SELECT 'candidates', count(*) FROM cand UNION ALL SELECT 'user_stats', count(*) FROM st")
def _(t):
    base = new_path(t.spark, "backfill")
    rebuild(t, base)
    parts = [t.spark.read.parquet(f"{base}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("likes", "edges", "zaps", "candidates", "user_stats")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query_of("s4_event_log", "SELECT strftime(created_at, '%Y-%m') AS month, ev.id, CAST(kind AS INT) AS kind, len(tags) AS n_tags, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM ev JOIN rl ON rl.event_id = ev.id GROUP BY ALL")
def _(t):
    path = new_path(t.spark, "event-log")
    write_events(t.events.drop("event_id", "user_id"), path, t.relays)
    log = t.spark.read.option("basePath", path).schema("id string, kind int, tags_json string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, month string").parquet(path)
    return log.select("month", "id", "kind", F.json_array_length("tags_json").cast("long").alias("n_tags"), "first_seen_at", "last_seen_at")


#: Files that the frames come in at least, and events a file as they grow.
FRAME_FILES, FRAMES_A_FILE = 8, 250_000
#: Events that a task parses where a batch is a few such files; compressed files are not split in reading.
EVENTS_A_TASK = 32_000
#: Events a batch of a run in several ones, and such batches at least. Each batch writes every partition of the state anew.
EVENTS_A_BATCH, BATCHES = 500_000, 8


def _files(t) -> int:
    return max(FRAME_FILES, -(-t.bounds.rows // FRAMES_A_FILE))


def _pieces(t) -> int:
    """Files that one of :func:`_files` is laid in, so that more than one task parses it."""
    return max(1, -(-t.bounds.rows // (_files(t) * EVENTS_A_TASK)))


def _batches(t) -> int:
    return max(BATCHES, -(-t.bounds.rows // EVENTS_A_BATCH))


def in_time(t, pieces: int = 1) -> DataFrame:
    """The numbers in partitions that follow each other in time: what events are worked out of, so that only numbers move."""
    return t.numbers.repartitionByRange(_files(t) * pieces, "created_at", F.expr("sha2('e' || event_id, 256)"))


def _frames(t, ahead=False, late=False, pieces=1):
    """The events as relay frames, each from two relays, one in fifty malformed; partitions follow each other in time of arrival.

    ``ahead``: one in fifty claims a time an hour after its arrival. ``late``: frames arrive in no order of time, the two copies of an event far apart.
    ``pieces``: files to each one that there would be.
    """
    # the order is made of numbers; what a frame holds is worked out after it
    relays = F.explode(F.array(F.lit("wss://a"), F.lit("wss://b"))).alias("relay")
    if late:
        rows = t.numbers.select("*", relays).repartitionByRange(_files(t), F.xxhash64("event_id", "relay"))
    else:
        rows = in_time(t, pieces)
    e = t.canonical(rows).selectExpr("id", "pubkey", "kind", "timestampdiff(SECOND, timestamp_ntz '1970-01-01', created_at) AS arrival", "tags", "content", "repeat('0', 128) AS sig", "event_id", *(["relay"] if late else []))
    claimed = F.when(F.col("event_id") % 50 == 7, F.col("arrival") + 3600).otherwise(F.col("arrival")) if ahead else F.col("arrival")
    e = e.withColumn("created_at", claimed)
    body = F.to_json(F.struct("id", "pubkey", "created_at", "kind", "tags", "content", "sig"))
    frame = F.when(F.col("event_id") % 50 == 49, F.concat(F.lit('["EVENT","s",'), body)).when(F.col("event_id") % 50 == 48, '["EOSE","s"]').otherwise(F.concat(F.lit('["EVENT","s",'), body, F.lit("]")))
    return e.select(frame.alias("value"), F.timestamp_seconds("arrival").alias("ingest_ts"), "relay" if late else relays)


@query_of("s1_decoded_frames", "SELECT id, pubkey, kind, created_at, CAST(len(tags) AS INT) AS n_tags FROM ev WHERE event_id % 50 < 48")
def _(t):
    return decode_frames(_frames(t).where("relay = 'wss://a'")).select("id", "pubkey", "kind", "created_at", F.size("tags").alias("n_tags"))


@query_of("s2_shape_check", "SELECT id, CASE WHEN event_id % 50 = 3 THEN 'content' WHEN event_id % 50 = 2 THEN 'pubkey' END AS reason FROM ev WHERE event_id % 50 IN (2, 3)")
def _(t):
    e = t.events.withColumn("sig", F.repeat(F.lit("0"), F.lit(128)))
    e = e.withColumn("pubkey", F.when(F.col("event_id") % 50 == 2, F.substring("pubkey", 1, 60)).otherwise(F.col("pubkey"))).withColumn("content", F.when(F.col("event_id") % 50 == 3, F.repeat(F.lit("x"), F.lit(1_000_001))).otherwise(F.col("content")))
    return split_by_shape(e)[1].select("id", "reason")


@query_of("s3_true_ids", "SELECT sha256('[0,' || CAST(to_json(pubkey) AS VARCHAR) || ',' || CAST(epoch(created_at) AS BIGINT) || ',' || kind || ',' || CAST(to_json(tags) AS VARCHAR) || ',' || CAST(to_json(content) AS VARCHAR) || ']') AS id, event_id FROM ev WHERE event_id % 3 <> 0")
def _(t):
    from socialspark.sources.ingest import canonical_id

    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at"))
    e = t.events.withColumn("id", F.when(F.col("event_id") % 3 == 0, F.col("id")).otherwise(canonical_id("pubkey", seconds, "kind", "tags", "content")))
    return with_true_ids(e).select("id", "event_id")


@query_of("s12_annotations", "SELECT id AS event_id, 'contribution_quality' AS metric, round(greatest(least(rel * 0.25 + inf * 0.35 + nov * 0.15 + con * 0.25, 1), 0), 6) AS value, 'unknown' AS model_version FROM ql3", *_QL)
def _(t):
    quality = enrich.quality_columns(t.replies_with_text)
    a = quality.select(F.col("id").alias("event_id"), "pubkey", "kind", "created_at", F.array(F.struct(F.lit("contribution_quality").alias("name"), F.col("contribution_quality").alias("value")), F.struct(F.lit(" ").alias("name"), F.lit(0.0).alias("value"))).alias("metrics"), F.lit("").alias("model_version"), F.col("created_at").alias("computed_at"))
    return annotation_rows(a).select("event_id", "metric", F.round("value", 6).alias("value"), "model_version")


def _ended(query):
    """Wait for a run over what is there. It ends by itself, however long its input takes, or raises what stopped it."""
    query.awaitTermination()


def _stream(t, after, files_per_batch=100, batches=None, **order):
    """Run a streaming plan over the frames, in order of arrival, to its end and return what it wrote.

    ``batches``: how many at most, however many files the frames are laid in.
    """
    base = new_path(t.spark, "stream")
    st.write_folder(_frames(t, **order), f"{base}/in")
    files = st.in_file_order(t.spark, f"{base}/in")
    frames = st.read_folder(t.spark, f"{base}/in", max(1, -(-files // batches)) if batches else files_per_batch)
    _ended(after(frames, base))
    return base


@query_of("st1_st2_st7_stream_views", "SELECT tag_value AS target_event_id, count(DISTINCT pubkey) AS likes FROM tg WHERE kind = 7 AND tag_key = 'e' AND event_id IN (SELECT id FROM ev WHERE event_id % 50 < 48) GROUP BY 1")
def _(t):
    def run(frames, base):
        events = st.seen_once(st.valid_events(frames))
        return st.micro_batches(events, f"{base}/state", once=True).foreachBatch(st.write_views(f"{base}/out", ("events", "likes", "zaps"))).start()

    base = _stream(t, run)
    return t.spark.read.schema("target_event_id string, pubkey string").parquet(f"{base}/out/likes").groupBy("target_event_id").agg(F.count_distinct("pubkey").alias("likes"))


@query_of("st4_stream_daily_cap", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY pubkey, CAST(created_at AS DATE) ORDER BY created_at, id) AS r FROM ev WHERE kind IN (1, 6, 16, 1111) AND event_id % 50 < 48 AND pubkey NOT IN (SELECT pubkey FROM ls WHERE score >= 90)) WHERE r <= 2 UNION ALL SELECT id FROM ev WHERE event_id % 50 < 48 AND (kind NOT IN (1, 6, 16, 1111) OR pubkey IN (SELECT pubkey FROM ls WHERE score >= 90))")
def _(t):
    exempt = jobs.scored_actors(t.scores, 90)

    def run(frames, base):
        events = st.capped(st.valid_events(frames.where("relay = 'wss://a'")).select("id", "pubkey", "kind", "ingest_ts"), exempt, 2)
        return st.micro_batches(events.select("id"), f"{base}/state", once=True).format("parquet").option("path", f"{base}/out").outputMode("append").start()

    return t.spark.read.schema("id string").parquet(f"{_stream(t, run)}/out")


@query_of("st3_ahead_of_time", "SELECT id, event_id % 50 = 7 AS ahead FROM ev WHERE event_id % 50 < 48")
def _(t):
    def run(frames, base):
        return st.micro_batches(st.seen_once(st.valid_events(frames).select("id", "ahead", "ingest_ts")).drop("ingest_ts"), f"{base}/state", once=True).format("parquet").option("path", f"{base}/out").outputMode("append").start()

    return t.spark.read.schema("id string, ahead boolean").parquet(f"{_stream(t, run, ahead=True)}/out")


@query_of("st3_relay_marks", "SELECT relay, max(created_at) AS mark, max(created_at) - INTERVAL 5 MINUTE AS resume_at FROM ev, (VALUES ('wss://a'), ('wss://b')) AS r(relay) WHERE event_id % 50 < 48 AND event_id % 50 <> 7 GROUP BY 1")
def _(t):
    def run(frames, base):
        return st.micro_batches(st.relay_marks(st.valid_events(frames)), f"{base}/state", once=True).outputMode("complete").foreachBatch(st.write_table(f"{base}/marks")).start()

    base = _stream(t, run, 4, ahead=True)
    rows = t.spark.read.option("basePath", f"{base}/marks").schema("relay string, mark timestamp_ntz, resume_at timestamp_ntz, batch int").parquet(f"{base}/marks")
    return rows.groupBy("relay").agg(F.max_by(F.struct("mark", "resume_at"), "batch").alias("m")).select("relay", "m.*")


_VIEW_ROWS = {
    "events": ("id string, kind int", "id AS key, cast(kind AS string) AS value"), "likes": ("target_event_id string, pubkey string", "target_event_id AS key, pubkey AS value"),
    "reposts": ("target_event_id string, pubkey string", "target_event_id AS key, pubkey AS value"), "quotes": ("target_event_id string, event_id string", "target_event_id AS key, event_id AS value"),
    "posts": ("pubkey string, id string", "pubkey AS key, id AS value"), "zaps": ("zap_receipt_id string, sats long", "zap_receipt_id AS key, cast(sats AS string) AS value"),
    "contacts": ("pubkey string, event_id string, created_at timestamp_ntz, contacts array<string>", "pubkey AS key, event_id || ':' || size(contacts) AS value"),
    "candidates": ("viewer string, event_id string, reason string", "viewer AS key, event_id || ':' || reason AS value"),
    "profiles": ("pubkey string, event_id string, created_at timestamp_ntz, name string", "pubkey AS key, event_id || ':' || name AS value"),
}
_VIEW_SQL = {
    "events": "SELECT 'events' AS view, id AS key, CAST(kind AS VARCHAR) AS value FROM ev2",
    "likes": "SELECT DISTINCT 'likes', tag_value, pubkey FROM tg2 WHERE kind = 7 AND tag_key = 'e' AND strlen(tag_value) = 64",
    "reposts": "SELECT DISTINCT 'reposts', tag_value, pubkey FROM tg2 WHERE kind IN (6, 16) AND tag_key = 'e' AND strlen(tag_value) = 64",
    "quotes": "SELECT DISTINCT 'quotes', tag_value, event_id FROM tg2 WHERE kind = 1 AND tag_key = 'q' AND strlen(tag_value) = 64",
    "posts": "SELECT 'posts', pubkey, id FROM ev2 WHERE kind IN (1, 1111)",
    "zaps": "SELECT 'zaps', zap_receipt_id, CAST(sats AS VARCHAR) FROM zaps WHERE zap_receipt_id IN (SELECT id FROM ev2)",
    "contacts": "SELECT 'contacts', pubkey, id || ':' || len(list_filter(tags, lambda t: t[1] = 'p' AND strlen(t[2]) = 64)) FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, id DESC) AS r FROM ev2 WHERE kind = 3) WHERE r = 1",
    "candidates": "SELECT 'candidates', viewer, event_id || ':' || reason FROM cand WHERE event_id IN (SELECT id FROM ev2)",
    "profiles": "SELECT 'profiles', pubkey, id || ':' || coalesce(content ->> '$.name', '') FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, id DESC) AS r FROM ev2 WHERE kind = 0) WHERE r = 1",
}
_EV2, _TG2 = ("ev2", "SELECT * FROM ev WHERE event_id % 50 < 48"), ("tg2", "SELECT * FROM tg WHERE event_id IN (SELECT id FROM ev2)")


def _views(t, names, files_per_batch=100, dedup=True, **order):
    def run(frames, base):
        events = st.valid_events(frames)
        return st.micro_batches(st.seen_once(events) if dedup else events, f"{base}/state", once=True).foreachBatch(st.write_views(f"{base}/out", names)).start()

    base, out = _stream(t, run, files_per_batch, **order), None
    for name in names:
        schema, pair = _VIEW_ROWS[name]
        rows = st.read_view(t.spark, f"{base}/out", name, schema).selectExpr(f"'{name}' AS view", *pair.split(", ", 1))
        out = rows if out is None else out.unionByName(rows)
    return out


@query_of("st7_insert_views", " UNION ALL ".join(_VIEW_SQL.values()), _EV2, _TG2)
def _(t):
    return _views(t, tuple(_VIEW_ROWS))


@query_of("st8_late_and_repeated", " UNION ALL ".join(_VIEW_SQL[n] for n in ("events", "likes", "contacts", "profiles")), _EV2, _TG2)
def _(t):
    return _views(t, ("events", "likes", "contacts", "profiles"), 3, dedup=False, late=True)


_TOK9 = "SELECT id, pubkey, content AS text, lower(content) AS low, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{Nd}]+'), lambda x: strlen(x) >= 2) AS tok FROM ev WHERE event_id % 50 < 48 AND kind IN (1, 1111) AND len(list_filter(tags, lambda t: lower(t[1]) = 'e' AND len(t) >= 2)) > 0"
_EACH = ("SELECT id AS event_id, 'contribution_quality' AS metric, round(greatest(least(rel * 0.25 + inf * 0.35 + nov * 0.15 + con * 0.25, 1), 0), 6) AS value FROM ql3 UNION ALL SELECT id, 'reply_relevance', round(rel, 6) FROM ql3 "
         "UNION ALL SELECT id, 'reply_informativeness', round(inf, 6) FROM ql3 UNION ALL SELECT id, 'reply_novelty', round(nov, 6) FROM ql3 UNION ALL SELECT id, 'reply_constructiveness', round(con, 6) FROM ql3")


@query_of("st9_stream_annotations", _EACH, ("tok", _TOK9), *_QL[1:])
def _(t):
    def run(frames, base):
        events = st.seen_once(st.valid_events(frames))
        return st.micro_batches(events, f"{base}/state", once=True).foreachBatch(st.annotate(f"{base}/out", enrich.quality_metrics)).start()

    m = t.spark.read.schema("event_id string, metric string, value double").parquet(f"{_stream(t, run)}/out/metrics")
    return m.select("event_id", "metric", F.round("value", 6).alias("value"))
