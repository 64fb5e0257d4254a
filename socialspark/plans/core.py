"""Queries over filters, aggregates, per-key limits and materialised tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.functions import tags as tg
from socialspark.functions import text as tx
from socialspark.functions.tags import TagPredicate
from socialspark.operators import aggregate as ag
from socialspark.operators import jobs, latest, query
from socialspark.operators.aggregate import AggregateSpec
from socialspark.operators.query import EventQuery, TagFilter
from socialspark.plans.fixtures import Tables
from socialspark.plans.oracle import ALL_TARGETS, sql
from socialspark.sources.ingest import profiles

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query_of(name: str, oracle: str | None = None, *more: tuple[str, str]):
    """Register a function of the canonical tables as a query."""

    def wrap(f: Callable[[Tables], DataFrame]):
        Q[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            SQL[name] = sql(oracle, *more)
        return f

    return wrap


_IDS = ("id", "pubkey", "kind", "created_at")
_SHORT = "id, pubkey, kind, created_at"
_NEW = "ORDER BY created_at DESC, id DESC"
_E = "tag_key = 'e' AND strlen(tag_value) = 64"


@query_of("f1_event_query", f"SELECT {_SHORT} FROM ev WHERE kind IN (1, 7) AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20' {_NEW} LIMIT 100 OFFSET 20")
def _(t):
    return query.event_query(t.events, EventQuery(kinds=(1, 7), since="2024-01-05", until="2024-01-20", limit=100, offset=20)).select(*_IDS)


@query_of("f2_by_ids", f"SELECT {_SHORT} FROM ev WHERE id IN (SELECT tag_value FROM tg WHERE tag_key = 'q')")
def _(t):
    return query.by_ids(t.events, t.tags.where("tag_key = 'q'").select(F.col("tag_value").alias("id"))).select(*_IDS)


@query_of("f3_include_keys", f"SELECT {_SHORT} FROM ev WHERE kind IN (0, 3, 10002) AND pubkey IN (SELECT followed FROM fe)")
def _(t):
    follows = jobs.follow_edges(t.contacts)
    return query.in_keys(query.in_list(t.events, "kind", (0, 3, 10002)), "pubkey", follows, "followed").select(*_IDS)


@query_of("f4_exclude_keys", f"SELECT {_SHORT} FROM ev WHERE kind = 1 AND id NOT IN (SELECT tag_value FROM tg WHERE tag_key = 'e')")
def _(t):
    return query.not_in_keys(t.events.where("kind = 1"), "id", t.tags.where("tag_key = 'e'"), "tag_value").select(*_IDS)


@query_of("f5_tag_filters", f"SELECT {_SHORT} FROM ev WHERE id IN (SELECT event_id FROM tg WHERE tag_key = 'e') AND id IN (SELECT event_id FROM tg WHERE tag_key = 'amount')")
def _(t):
    return query.with_tag(query.with_tag(t.events, t.tags, TagFilter("e")), t.tags, TagFilter("amount")).select(*_IDS)


@query_of("f6_tag_exclusion", f"SELECT {_SHORT} FROM ev WHERE kind = 30078 AND id NOT IN (SELECT event_id FROM tg WHERE tag_key = 'd' AND tag_value = 'seen')")
def _(t):
    return query.with_tag(t.events.where("kind = 30078"), t.tags, TagFilter("d", ("seen",)), "left_anti").select(*_IDS)


_KEYWORDS = "SELECT id AS event_id, pubkey, 'keyword' AS tag_key, k AS tag_value FROM ev, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS w(k) WHERE kind IN (1, 1111) AND list_contains(string_split(content, ' '), k)"


@query_of("f7_derived_tags", "SELECT 'raw' AS dataset, event_id AS id FROM tg WHERE tag_key = 'r' AND tag_value = 'wss://b.example' UNION ALL SELECT 'derived', event_id FROM dt WHERE tag_value IN ('click', 'view')", ("dt", _KEYWORDS))
def _(t):
    ask = {"raw": (t.tags, TagFilter("r", ("wss://b.example",))), "derived": (t.derived_tags, TagFilter("keyword", ("click", "view")))}
    parts = [query.with_tag(t.events, tags, f).select(F.lit(name).alias("dataset"), "id") for name, (tags, f) in ask.items()]
    return parts[0].unionByName(parts[1])


@query_of("f8_search", f"SELECT {_SHORT} FROM ev WHERE contains(lower(content), 'about purchase 9')")
def _(t):
    return t.events.where(tx.contains_ci(F.col("content"), "About PURCHASE 9")).select(*_IDS)


@query_of("f9_reputable", f"SELECT {_SHORT} FROM ev WHERE kind = 6 AND pubkey IN (SELECT pubkey FROM sc WHERE source = 'reputation' GROUP BY pubkey HAVING max(followers) >= 600)")
def _(t):
    return query.reputable(t.events.where("kind = 6"), t.scores, 600).select(*_IDS)


@query_of("f10_time_bounds", "SELECT event_id, relay FROM rl WHERE last_seen_at >= TIMESTAMP '2024-01-10 00:00:00' AND last_seen_at < TIMESTAMP '2024-01-11 12:00:00'")
def _(t):
    return query.between(t.relays, "2024-01-10 00:00:00", "2024-01-11 12:00:00", "last_seen_at").select("event_id", "relay")


@query_of("f11_tag_predicate", "SELECT id, list_filter(tags, lambda t: t[1] = 'e' AND coalesce(t[4], '') = 'root')[1][2] AS root, len(list_filter(tags, lambda t: t[1] = 'e' AND coalesce(t[4], '') NOT IN ('root'))) AS others FROM ev WHERE kind IN (1, 1111)")
def _(t):
    tags = F.col("tags")
    return t.events.where("kind IN (1, 1111)").select("id", F.get(TagPredicate("e", markers=("root",)).values_of(tags), F.lit(0)).alias("root"), F.size(TagPredicate("e", exclude_markers=("root",)).select(tags)).cast("long").alias("others"))


@query_of("f12_dynamic_pubkeys", """SELECT pubkey, value FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY lr, place) AS k FROM (SELECT pubkey, value, arg_min(lr, lr * 1000 + place) AS lr, arg_min(place, lr * 1000 + place) AS place FROM
 (SELECT pubkey, lr, i AS place, tags[i + 1][2] AS value, tags[i + 1][1] AS key FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, id DESC) AS lr FROM ev WHERE kind = 3), unnest(range(len(tags))) AS u(i) WHERE lr <= 2) WHERE key = 'p' GROUP BY pubkey, value)) WHERE k <= 12""")
def _(t):
    return query.dynamic_pubkeys(t.events, 3, TagPredicate("p"), newest=2, max_values=12)


@query_of("f13_own_references", "SELECT DISTINCT tg.event_id, tag_value AS target_id, tg.pubkey FROM tg JOIN ev ON ev.id = tag_value AND ev.pubkey = tg.pubkey WHERE tag_key = 'e'")
def _(t):
    return query.own_references(t.tags, t.events).select("event_id", "target_id", "pubkey")


@query_of("f14_bounded_query", f"SELECT {_SHORT} FROM ev WHERE id IN (SELECT event_id FROM tg WHERE tag_key = 'd' AND tag_value IN ('seen', 'other')) {_NEW} LIMIT 500")
def _(t):
    return query.event_query(t.events, EventQuery(tags=(TagFilter("d", ("seen", "other")),), limit=500), t.tags).select(*_IDS)


@query_of("f15_addresses", "SELECT id, CAST(kind AS VARCHAR) || ':' || pubkey || ':' || CASE WHEN kind = 30078 THEN list_filter(tags, lambda t: t[1] = 'd')[1][2] ELSE '' END AS address FROM ev WHERE kind IN (0, 3, 10002, 10000, 30078)")
def _(t):
    return t.events.select("id", tg.address(F.col("kind"), F.col("pubkey"), F.col("tags")).alias("address")).where("address IS NOT NULL")


def _spec(name, spec, body, source="events"):
    @query_of(name, body)
    def _(t, spec=spec, source=source):
        return ag.aggregate(getattr(t, source), spec)


_spec("a1_events_by_kind_author", AggregateSpec("EVENTS", ("KIND", "PUBKEY"), ("COUNT", "UNIQUE_EVENTS"), 500), "SELECT kind, pubkey, count(*) AS count, count(DISTINCT id) AS unique_events FROM ev GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 500")
_spec("a2_tags_by_key_value", AggregateSpec("TAGS", ("TAG_KEY", "TAG_VALUE"), ("UNIQUE_AUTHORS", "COUNT"), 300), "SELECT tag_key, tag_value, count(DISTINCT pubkey) AS unique_authors, count(*) AS count FROM tg GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 300", "tags")
_spec("a4_relays", AggregateSpec("RELAYS", ("RELAY",), ("COUNT", "UNIQUE_EVENTS"), 100), "SELECT relay, count(*) AS count, count(DISTINCT event_id) AS unique_events FROM rl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", "relays")
_spec("a5_days_hours", AggregateSpec("EVENTS", ("DAY", "HOUR", "KIND"), ("COUNT",), 1000), "SELECT CAST(created_at AS DATE) AS day, date_trunc('hour', created_at) AS hour, kind, count(*) AS count FROM ev GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 1000")
_spec("a6_content", AggregateSpec("EVENTS", ("CONTENT",), ("COUNT", "UNIQUE_AUTHORS"), 50), "SELECT content, count(*) AS count, count(DISTINCT pubkey) AS unique_authors FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
_spec("a7_tag_metrics", AggregateSpec("TAGS", ("KIND",), ("UNIQUE_EVENTS", "UNIQUE_PUBKEYS", "UNIQUE_TAG_VALUES", "COUNT")), "SELECT kind, count(DISTINCT event_id) AS unique_events, count(DISTINCT pubkey) AS unique_pubkeys, count(DISTINCT tag_value) AS unique_tag_values, count(*) AS count FROM tg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", "tags")
_spec("a23_daily_activity", AggregateSpec("EVENTS", ("DAY", "KIND", "PUBKEY"), ("COUNT",), 1000), "SELECT CAST(created_at AS DATE) AS day, kind, pubkey, count(*) AS count FROM ev GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 1000")


@query_of("a3_derived_tags", "SELECT tag_value, count(*) AS count, count(DISTINCT pubkey) AS unique_authors FROM dt GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", ("dt", _KEYWORDS))
def _(t):
    return ag.aggregate(t.derived_tags, AggregateSpec("DERIVED_TAGS", ("TAG_VALUE",), ("COUNT", "UNIQUE_AUTHORS")))


_REFS = """SELECT tag_value, event_id, pubkey, kind, created_at, row_number() OVER (PARTITION BY tag_value ORDER BY created_at DESC, event_id DESC) AS r FROM (SELECT DISTINCT tag_value, event_id, pubkey, kind, created_at FROM tg WHERE tag_key = 'e')"""


@query_of("a8_references_per_target", "SELECT target_id, kind, n, authors FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY n DESC, kind) AS k FROM (SELECT tag_value AS target_id, kind, count(*) AS n, count(DISTINCT pubkey) AS authors FROM refs WHERE r <= 5 AND tag_value IN (SELECT id FROM ev WHERE kind = 1) GROUP BY 1, 2)) WHERE k <= 2", ("refs", _REFS))
def _(t):
    return ag.references_per_target(t.events.where("kind = 1"), t.tags, newest=5, dims=("kind",), metrics=(("n", "COUNT", "event_id"), ("authors", "COUNT_DISTINCT", "pubkey")), first=2)


@query_of("a9_references_or_zero", "SELECT id AS target_id, count(event_id) AS n, count(DISTINCT refs.pubkey) AS authors FROM (SELECT id FROM ev WHERE kind = 1) e LEFT JOIN refs ON tag_value = id AND r <= 500 GROUP BY 1", ("refs", _REFS))
def _(t):
    return ag.references_per_target(t.events.where("kind = 1"), t.tags, metrics=(("n", "COUNT", "event_id"), ("authors", "COUNT_DISTINCT", "pubkey")))


@query_of("a9_zap_selectors", """SELECT id, CASE WHEN m > 0 THEN m ELSE 0 END AS msats, (CASE WHEN m > 0 THEN m ELSE 0 END) // 1000 AS sats, sender FROM (SELECT id, coalesce(try_cast((list_filter(tags, lambda t: t[1] = 'description')[1][2] ->> '$.tags[0][1]') AS BIGINT), 0) AS m, list_filter(tags, lambda t: t[1] = 'P')[1][2] AS sender FROM ev WHERE kind = 9735)""")
def _(t):
    m = tg.zap_msats(F.col("tags"))
    return t.events.where("kind = 9735").select("id", m.alias("msats"), F.floor(m / 1000).cast("long").alias("sats"), tg.zap_sender(F.col("tags"), F.col("pubkey")).alias("sender"))


@query_of("a10_referenced_targets", "SELECT tag_value AS target_id, target_pubkey, count(DISTINCT event_id) AS n FROM (SELECT tg.*, ev.pubkey AS target_pubkey FROM tg JOIN ev ON ev.id = tag_value AND ev.kind = 1 WHERE tag_key = 'e') GROUP BY 1, 2")
def _(t):
    return ag.referenced_targets(t.tags, t.events.where("kind = 1")).groupBy(F.col("tag_value").alias("target_id"), "target_pubkey").agg(F.count_distinct("event_id").alias("n"))


@query_of("a11_text_numbers", "SELECT pubkey, CAST(sum(v) AS BIGINT) AS total, CAST(floor(avg(v)) AS BIGINT) AS mean, min(v) AS least, max(v) AS most FROM (SELECT pubkey, CASE WHEN regexp_matches(tag_value, '^[0-9]+$') THEN CAST(tag_value AS BIGINT) ELSE 0 END AS v FROM tg WHERE kind = 9735 AND tag_key IN ('amount', 'bolt11')) GROUP BY 1")
def _(t):
    v, rows = F.col("tag_value"), t.tags.where("kind = 9735 AND tag_key IN ('amount', 'bolt11')")
    return rows.groupBy("pubkey").agg(*[ag.value_metric(f, v).alias(n) for n, f in (("total", "SUM"), ("mean", "AVG"), ("least", "MIN"), ("most", "MAX"))])


@query_of("a12_kind_counts", "SELECT CAST(k AS INT) AS kind, count(id) AS n FROM (VALUES (1), (7), (9735), (443)) AS v(k) LEFT JOIN ev ON ev.kind = k GROUP BY 1")
def _(t):
    return ag.kind_counts(t.events, (1, 7, 9735, 443))


@query_of("a13_post_counts", "SELECT pubkey, count(DISTINCT id) AS posts FROM ev WHERE kind IN (1, 1111) GROUP BY 1")
def _(t):
    return jobs.post_counts(t.events)


@query_of("a14_direct_reply_counts", "SELECT id AS target_event_id, replies FROM rc")
def _(t):
    return jobs.direct_reply_counts(t.edges)


@query_of("a15_zap_totals", "SELECT id AS target_event_id, CAST(sats AS BIGINT) AS sats, zaps FROM zt")
@query_of("m4_note_zap_totals", "SELECT id AS target_event_id, CAST(sats AS BIGINT) AS sats, zaps FROM zt")
def _(t):
    return jobs.zap_totals(t.zaps)


@query_of("a16_conditional_picks", "SELECT event_id, arg_min(tag_value, tag_index) FILTER (marker = 'root') AS root, arg_max(tag_value, tag_index) FILTER (marker = '') AS last_plain, count(*) FILTER (marker IN ('', 'root', 'reply')) AS refs FROM tg WHERE tag_key = 'e' GROUP BY 1")
def _(t):
    pick = lambda f, m: f(F.when(F.col("marker") == m, F.col("tag_value")), F.when(F.col("marker") == m, F.col("tag_index")))
    return t.tags.where("tag_key = 'e'").groupBy("event_id").agg(pick(F.min_by, "root").alias("root"), pick(F.max_by, "").alias("last_plain"), F.count_if(F.col("marker").isin("", "root", "reply")).alias("refs"))


@query_of("a17_latest_score", "SELECT pubkey, score, followers FROM ls")
def _(t):
    return jobs.latest_scores(t.scores).select("pubkey", "score", "followers")


@query_of("a18_follower_counts", "SELECT pubkey, followers FROM fc")
def _(t):
    return jobs.follower_counts(t.contacts)


def _user_stats(t, touched=None):
    return jobs.user_stats(t.contacts, jobs.post_counts(t.events), profiles(t.events), touched)


_STATS = "SELECT pubkey, CAST(following AS BIGINT) AS following, CAST(followers AS BIGINT) AS followers, CAST(posts AS BIGINT) AS posts FROM st"


@query_of("a19_user_stats", _STATS)
def _(t):
    return _user_stats(t)


@query_of("m7_user_stats_touched", _STATS + " WHERE pubkey IN (SELECT pubkey FROM ev, bnd WHERE created_at >= as_of - INTERVAL 1 DAY)")
def _(t):
    return _user_stats(t, t.events.where(F.col("created_at") >= t.as_of - F.expr("INTERVAL 1 DAY")))


@query_of("a21_having", "SELECT pubkey, followers FROM fc WHERE followers >= 8")
def _(t):
    return jobs.follower_counts(t.contacts).where("followers >= 8")


@query_of("a22_first_event", "SELECT k.pubkey, min(created_at) AS first_at FROM (SELECT DISTINCT pubkey FROM sc) k LEFT JOIN (SELECT * FROM ev WHERE kind = 0) e USING (pubkey) GROUP BY 1")
def _(t):
    return ag.first_event_time(t.scores, t.events.where("kind = 0"))


@query_of("a24_reaction_breakdown", "SELECT tag_value AS target_id, CASE WHEN content IN ('+', '') THEN 'like' WHEN content = '-' THEN 'dislike' ELSE content END AS reaction, count(*) AS n FROM (SELECT DISTINCT event_id, tag_value FROM tg WHERE kind = 7 AND tag_key = 'e') t JOIN ev ON ev.id = t.event_id GROUP BY 1, 2")
def _(t):
    return ag.reaction_breakdown(t.events, t.tags)


@query_of("m1_note_like_counts", "SELECT id AS target_event_id, likes FROM lk")
def _(t):
    return jobs.like_counts(t.tags)


@query_of("m2_note_repost_counts", "SELECT id AS target_event_id, reposts FROM rp")
def _(t):
    return jobs.repost_counts(t.tags)


@query_of("m3_note_quote_counts", "SELECT id AS target_event_id, quotes FROM qt")
def _(t):
    return jobs.quote_counts(t.tags)


@query_of("m5_note_reply_edges", "SELECT child_id, parent_id, child_pubkey, kind, created_at FROM edges")
def _(t):
    return t.edges


@query_of("m6_user_contacts_latest", "SELECT pubkey, event_id, created_at, array_to_string(contacts, ',') AS contacts FROM ct")
def _(t):
    return t.contacts.withColumn("contacts", F.concat_ws(",", "contacts"))


def _real(t):
    targets = jobs.engaged_targets(t.tags, t.zaps, t.as_of - F.expr("INTERVAL 10 DAYS"))
    return jobs.engagement_real(targets, t.tags, t.zaps, t.edges, t.events, t.scores)


@query_of("m8_note_engagement_real", "SELECT * FROM realc", ALL_TARGETS)
def _(t):
    return _real(t)


@query_of("m10_notification_candidates", "SELECT viewer, event_id, actor_pubkey, created_at, kind, reason FROM cand")
def _(t):
    return jobs.notification_candidates(t.tags)


@query_of("m12_profiles_latest", "SELECT * FROM pf")
@query_of("s9_profiles", "SELECT * FROM pf")
def _(t):
    return profiles(t.events)


@query_of("m13_addressable_latest", "SELECT address, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY created_at DESC, id DESC) AS r FROM (SELECT *, CAST(kind AS VARCHAR) || ':' || pubkey || ':' || CASE WHEN kind = 30078 THEN list_filter(tags, lambda t: t[1] = 'd')[1][2] ELSE '' END AS address FROM ev WHERE kind IN (0, 3, 10002, 10000, 30078))) WHERE r = 1")
def _(t):
    return jobs.addressable_latest(t.events).select("address", "id", "created_at")


@query_of("w1_latest_per_key", f"SELECT pubkey, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY pubkey, kind {_NEW}) AS r FROM ev) WHERE r = 1")
def _(t):
    return latest.latest(t.events, ["pubkey", "kind"], [F.desc("created_at"), F.desc("id")]).select("pubkey", "kind", "id")


@query_of("w2_latest_n_per_author", f"SELECT pubkey, id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pubkey {_NEW}) AS r FROM ev WHERE kind IN (1, 6)) WHERE r <= 5")
def _(t):
    return query.latest_per_author(t.events, (1, 6), 5).select("pubkey", "id", "rank")


@query_of("w3_newest_references", "SELECT tag_value AS target_id, event_id, CAST(r AS INT) AS rank FROM refs WHERE r > 1 AND r <= 4", ("refs", _REFS))
def _(t):
    rows = t.tags.where("tag_key = 'e'").dropDuplicates(["tag_value", "event_id"])
    return latest.top_per_key(rows, ["tag_value"], [F.desc("created_at"), F.desc("event_id")], 3, 1, name="rank").select(F.col("tag_value").alias("target_id"), "event_id", "rank")


@query_of("w4_earliest_follow", "SELECT viewer, event_id, actor_pubkey, reason FROM (SELECT *, row_number() OVER (PARTITION BY viewer, reason, actor_pubkey ORDER BY created_at, event_id) AS r FROM cand) WHERE reason <> 'follow' OR r = 1")
def _(t):
    return latest.earliest_follow_only(jobs.notification_candidates(t.tags)).select("viewer", "event_id", "actor_pubkey", "reason")


@query_of("w5_first_candidate", "SELECT viewer, event_id, reason FROM cand")
def _(t):
    return jobs.notification_candidates(t.tags).dropDuplicates(["viewer", "event_id", "reason"]).select("viewer", "event_id", "reason")


@query_of("w6_top_after_aggregation", "SELECT target_id, pubkey, n FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY n DESC, pubkey) AS k FROM (SELECT tag_value AS target_id, pubkey, count(*) AS n FROM refs WHERE tag_value IN (SELECT id FROM ev WHERE kind = 1) AND r <= 500 GROUP BY 1, 2)) WHERE k <= 3", ("refs", _REFS))
def _(t):
    return ag.references_per_target(t.events.where("kind = 1"), t.tags, dims=("pubkey",), first=3)


@query_of("w7_daily_cap", "SELECT id, r > 2 AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY pubkey, CAST(created_at AS DATE) ORDER BY created_at, id) AS r FROM ev WHERE kind IN (1, 6, 16, 1111) AND pubkey NOT IN (SELECT pubkey FROM ls WHERE score >= 90)) UNION ALL SELECT id, false FROM ev WHERE kind NOT IN (1, 6, 16, 1111) OR pubkey IN (SELECT pubkey FROM ls WHERE score >= 90)")
def _(t):
    exempt = jobs.scored_actors(t.scores, 90)
    return latest.daily_cap(t.events.withColumn("ingest_ts", F.col("created_at")), exempt, 2).select("id", "dropped")


@query_of("t1_newest_first", f"SELECT id, created_at FROM ev {_NEW} LIMIT 200 OFFSET 50")
def _(t):
    return latest.newest_first(t.events, 200, 50).select("id", "created_at")


@query_of("t2_seeded_order", "SELECT id, CAST('0x' || substr(sha256(id || 's3'), 1, 13) AS BIGINT) AS shuffle FROM ev WHERE kind = 7 ORDER BY date_trunc('day', created_at) DESC, 2, 1 LIMIT 100")
def _(t):
    rows = t.events.where("kind = 7").withColumn("day", F.date_trunc("day", "created_at"))
    return latest.seeded_order(rows, "s", 3, 100, "day").select("id", "shuffle")


@query_of("t3_jitter", "SELECT id, round(CAST(CAST('0x' || substr(sha256(id || 's1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * 0.15, 9) AS jitter FROM ev WHERE kind = 1")
def _(t):
    return t.events.where("kind = 1").select("id", F.round(tx.jitter(F.col("id"), "s", 1), 9).alias("jitter"))


@query_of("t5_complete_ranking", "SELECT ev.id, r AS rank FROM ev LEFT JOIN (SELECT id, row_number() OVER (ORDER BY likes DESC, id) AS r FROM (SELECT * FROM lk ORDER BY likes DESC, id LIMIT 20)) k USING (id) WHERE kind = 1 ORDER BY r NULLS LAST, created_at DESC, ev.id DESC LIMIT 60 OFFSET 5")
def _(t):
    top = jobs.like_counts(t.tags).select(F.col("target_event_id").alias("id"), "likes").orderBy(F.desc("likes"), "id").limit(20)
    ranking = latest.ranked(top.withColumn("all", F.lit(1)), ["all"], [F.desc("likes"), F.asc("id")])  # twenty rows
    return latest.complete_ranking(t.events.where("kind = 1"), ranking, 60, 5).select("id", F.col("rank").cast("long").alias("rank"))


@query_of("t7_cursor_page", "SELECT id, CAST(epoch(created_at) AS BIGINT) || '|' || id AS cursor FROM ev WHERE created_at <= TIMESTAMP '2024-01-15 00:00:00' AND id <> sha256('e0') ORDER BY created_at DESC, id DESC LIMIT 100")
def _(t):
    import hashlib

    return latest.page_until(t.events, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), hashlib.sha256(b"e0").hexdigest(), 100).select("id", "cursor")


@query_of("u1_union_distinct", "SELECT tag_value AS id FROM tg WHERE tag_key = 'e' UNION SELECT tag_value FROM tg WHERE tag_key = 'q'")
def _(t):
    part = lambda k: t.tags.where(F.col("tag_key") == k).select(F.col("tag_value").alias("id"))
    return part("e").union(part("q")).distinct()


@query_of("u2_union_all", "SELECT event_id, what, count(*) AS n FROM acts GROUP BY 1, 2")
def _(t):
    e = f"{jobs.REFERENCE}"
    parts = [t.tags.where(f"kind = 7 AND {e}").selectExpr("tag_value AS event_id", "'like' AS what"), t.tags.where(f"kind IN (6, 16) AND {e}").selectExpr("tag_value", "'repost'"),
             t.edges.selectExpr("parent_id", "'reply'"), t.tags.where("kind = 1 AND tag_key = 'q' AND octet_length(tag_value) = 64").selectExpr("tag_value", "'quote'"), t.zaps.selectExpr("target_event_id", "'zap'")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("event_id", "what").agg(F.count("*").alias("n"))


@query_of("u3_intersection", "SELECT tag_value AS id FROM tg WHERE tag_key = 'e' INTERSECT SELECT tag_value FROM tg WHERE tag_key = 'q'")
def _(t):
    part = lambda k: t.tags.where(F.col("tag_key") == k).select(F.col("tag_value").alias("id"))
    return part("e").intersect(part("q"))


@query_of("u4_merge_newest", f"SELECT id FROM (SELECT DISTINCT id, created_at FROM ev WHERE kind IN (1, 6) OR content = '') {_NEW} LIMIT 150")
def _(t):
    return latest.merge_newest([t.events.where("kind IN (1, 6)"), t.events.where("content = ''")], 150).select("id")


@query_of("u5_ordered_unique", "SELECT pubkey, tag_value AS value, CAST(min(tag_index) AS INT) AS position FROM tg WHERE kind = 10000 GROUP BY 1, 2")
def _(t):
    rows = t.tags.where("kind = 10000").select("pubkey", F.col("tag_value").alias("value"), F.col("tag_index").alias("position"))
    return latest.first_positions(rows, ["pubkey"], "value", "position")


@query_of("s5_event_tags", "SELECT event_id, CAST(tag_index AS INT) AS tag_index, tag_key, tag_value, array_to_string(tag_extra, ',') AS extra FROM tg")
def _(t):
    return t.tags.select("event_id", "tag_index", "tag_key", "tag_value", F.concat_ws(",", "tag_extra").alias("extra"))


@query_of("s6_relay_provenance", "SELECT relay, count(*) AS n, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM rl GROUP BY relay")
def _(t):
    from socialspark.sources.ingest import relay_provenance

    seen = t.relays.selectExpr("event_id", "relay", "explode(array(first_seen_at, last_seen_at)) AS seen_at")
    return relay_provenance(seen).groupBy("relay").agg(F.count("*").alias("n"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


@query_of("s7_note_zaps", "SELECT * FROM zaps")
def _(t):
    return t.zaps


@query_of("s11_after_cursor", "SELECT id, created_at FROM ev WHERE created_at > TIMESTAMP '2024-01-12 00:00:00' OR (created_at = TIMESTAMP '2024-01-12 00:00:00' AND id > '7') ORDER BY created_at, id LIMIT 256")
def _(t):
    from socialspark.sources.ingest import after_cursor

    return after_cursor(t.events, F.lit("2024-01-12 00:00:00").cast("timestamp_ntz"), F.lit("7"), 256).select("id", "created_at")


@query_of("e6_stale_authors", "SELECT a.pubkey, fc.followers, f.fetched_at FROM (SELECT DISTINCT pubkey FROM ev, bnd WHERE created_at >= as_of - INTERVAL 30 DAY) a JOIN fc USING (pubkey) JOIN bnd ON true LEFT JOIN (SELECT pubkey, max(fetched_at) AS fetched_at FROM sc GROUP BY 1) f USING (pubkey) WHERE fc.followers >= 2 AND (f.fetched_at IS NULL OR f.fetched_at < as_of - INTERVAL 6 HOUR) ORDER BY fc.followers DESC, a.pubkey LIMIT 500")
@query_of("j13_recent_authors", "SELECT a.pubkey, fc.followers, f.fetched_at FROM (SELECT DISTINCT pubkey FROM ev, bnd WHERE created_at >= as_of - INTERVAL 30 DAY) a JOIN fc USING (pubkey) JOIN bnd ON true LEFT JOIN (SELECT pubkey, max(fetched_at) AS fetched_at FROM sc GROUP BY 1) f USING (pubkey) WHERE fc.followers >= 2 AND (f.fetched_at IS NULL OR f.fetched_at < as_of - INTERVAL 6 HOUR) ORDER BY fc.followers DESC, a.pubkey LIMIT 500")
def _(t):
    return jobs.stale_authors(t.events, t.contacts, t.scores, t.as_of, 2, 500)


@query_of("q1_note_stats", "SELECT * FROM stats")
@query_of("j3_sparse_stats", "SELECT * FROM stats")
def _(t):
    return jobs.note_stats(t.events.where("kind = 1"), t.tags, t.zaps, t.edges)


@query_of("q2_direct_replies", "SELECT parent_id, child_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY created_at DESC, child_id DESC) AS INT) AS position FROM edges")
def _(t):
    return jobs.newest_children(t.edges)
