"""Queries over references, rankings, people, notifications, reviews, quality and retention."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.functions import tags as tg
from socialspark.functions import text as tx
from socialspark.functions.tags import TagPredicate
from socialspark.operators import enrich, graph, jobs, latest, notify, people, query, ranking, retention, reviews
from socialspark.plans.core import _REFS, _user_stats
from socialspark.plans.fixtures import Tables
from socialspark.plans.oracle import ALL_TARGETS, sql
from socialspark.sources.ingest import audit_units, profiles
from socialspark.sources.scratch import cut, new_path
from socialspark.streaming.ingest import ExemptAuthors

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query_of(name: str, oracle: str | None = None, *more: tuple[str, str]):
    def wrap(f: Callable[[Tables], DataFrame]):
        Q[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            SQL[name] = sql(oracle, *more)
        return f

    return wrap


def _edges(t):
    return t.edges


def _follows(t):
    return t.follows


# -- joins ---------------------------------------------------------------------------------------


@query_of("j1_hydrated_tags", "SELECT tg.event_id, tag_key, tag_value, content FROM tg JOIN ev ON ev.id = tg.event_id WHERE tag_key IN ('q', 'd')")
def _(t):
    e = t.events.select(F.col("id").alias("event_id"), "content")
    return t.tags.where("tag_key IN ('q', 'd')").join(e, "event_id").select("event_id", "tag_key", "tag_value", "content")


@query_of("j2_two_sided_references", "SELECT tg.event_id, tag_value AS target_id, s.content AS source_content, t.content AS target_content FROM tg JOIN ev s ON s.id = tg.event_id JOIN ev t ON t.id = tag_value WHERE tag_key = 'e' AND t.kind = 1 AND tg.kind = 7")
def _(t):
    source = t.events.select(F.col("id").alias("event_id"), F.col("content").alias("source_content"))
    target = t.events.where("kind = 1").select(F.col("id").alias("target_id"), F.col("content").alias("target_content"))
    return t.tags.where("tag_key = 'e' AND kind = 7").select("event_id", F.col("tag_value").alias("target_id")).join(target, "target_id").join(source, "event_id")


@query_of("j5_semi_join", "SELECT id FROM ev WHERE kind IN (6, 7) AND pubkey IN (SELECT pubkey FROM ls WHERE score >= 80)")
def _(t):
    return query.in_keys(t.events.where("kind IN (6, 7)"), "pubkey", jobs.scored_actors(t.scores, 80)).select("id")


@query_of("j6_anti_join", "SELECT id FROM ev WHERE kind = 1 AND id NOT IN (SELECT event_id FROM acts)")
def _(t):
    e = t.tags.where(jobs.REFERENCE + " AND kind IN (6, 7, 16)").select("tag_value")
    rows = e.union(_edges(t).select("parent_id")).union(t.tags.where("tag_key = 'q' AND kind = 1").select("tag_value")).union(t.zaps.select("target_event_id"))
    return query.not_in_keys(t.events.where("kind = 1"), "id", rows, "tag_value").select("id")


@query_of("j7_without_self", "SELECT DISTINCT tag_value AS target_id, tg.pubkey AS actor FROM tg JOIN ev ON ev.id = tag_value WHERE tg.kind = 7 AND tag_key = 'e' AND tg.pubkey <> ev.pubkey")
def _(t):
    a = t.tags.where("kind = 7 AND tag_key = 'e'").select(F.col("tag_value").alias("target_id"), F.col("pubkey").alias("actor"))
    return a.join(t.events.select(F.col("id").alias("target_id"), "pubkey"), "target_id").where("actor <> pubkey").select("target_id", "actor").distinct()


@query_of("j8_follow_directions", "SELECT a.pubkey AS viewer, p AS candidate, CASE WHEN x.follower IS NOT NULL AND y.follower IS NOT NULL THEN 'mutual' WHEN x.follower IS NOT NULL THEN 'following' WHEN y.follower IS NOT NULL THEN 'follows_you' ELSE 'none' END AS label FROM (SELECT DISTINCT pubkey, tag_value AS p FROM tg WHERE tag_key = 'p' AND kind IN (4, 10000)) a LEFT JOIN fe x ON x.follower = a.pubkey AND x.followed = p LEFT JOIN fe y ON y.follower = p AND y.followed = a.pubkey")
@query_of("q7_relationships", "SELECT a.pubkey AS viewer, p AS candidate, CASE WHEN x.follower IS NOT NULL AND y.follower IS NOT NULL THEN 'mutual' WHEN x.follower IS NOT NULL THEN 'following' WHEN y.follower IS NOT NULL THEN 'follows_you' ELSE 'none' END AS label FROM (SELECT DISTINCT pubkey, tag_value AS p FROM tg WHERE tag_key = 'p' AND kind IN (4, 10000)) a LEFT JOIN fe x ON x.follower = a.pubkey AND x.followed = p LEFT JOIN fe y ON y.follower = p AND y.followed = a.pubkey")
def _(t):
    pairs = t.tags.where("tag_key = 'p' AND kind IN (4, 10000)").select(F.col("pubkey").alias("viewer"), F.col("tag_value").alias("candidate")).distinct()
    return people.relationships(pairs, _follows(t))


@query_of("j9_actor_scores", "SELECT viewer, event_id, coalesce(score, 0) AS actor_score FROM cand LEFT JOIN ls ON ls.pubkey = actor_pubkey WHERE reason = 'zap'")
def _(t):
    s = jobs.latest_scores(t.scores).select(F.col("pubkey").alias("actor_pubkey"), "score")
    return jobs.notification_candidates(t.tags).where("reason = 'zap'").join(s, "actor_pubkey", "left").select("viewer", "event_id", F.coalesce("score", F.lit(0.0)).alias("actor_score"))


@query_of("j10_referenced_authors", "SELECT DISTINCT tg.event_id, ev.pubkey AS ref_author FROM tg JOIN ev ON ev.id = tag_value WHERE tag_key = 'e' AND tg.kind IN (1, 1111)")
def _(t):
    a = t.events.select(F.col("id").alias("tag_value"), F.col("pubkey").alias("ref_author"))
    return t.tags.where("tag_key = 'e' AND kind IN (1, 1111)").join(a, "tag_value").select("event_id", "ref_author").distinct()


@query_of("j11_decorated", "SELECT ev.id, coalesce(nullif(display_name, ''), nullif(name, '')) AS author_name, nullif(picture, '') AS author_picture FROM ev LEFT JOIN pf USING (pubkey) WHERE kind = 1111")
def _(t):
    return people.decorated(t.events.where("kind = 1111"), profiles(t.events)).select("id", "author_name", "author_picture")


# -- reads ---------------------------------------------------------------------------------------


@query_of("q3_ranked_replies", "SELECT parent_id, child_id, coalesce(likes, 0) AS score, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY coalesce(likes, 0) DESC, created_at DESC, child_id DESC) AS INT) AS position FROM edges LEFT JOIN lk ON lk.id = child_id")
def _(t):
    return graph.ranked_replies(_edges(t), jobs.like_counts(t.tags), "likes")


_CHAIN = "SELECT parent_id, child_pubkey, child_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, child_pubkey ORDER BY created_at, child_id) AS r FROM edges) WHERE r = 1"


@query_of("q4_authored_chain", "SELECT root_id, event_id, step FROM (WITH RECURSIVE c(root_id, author, event_id, step) AS (SELECT id, pubkey, id, 0 FROM ev WHERE kind = 1 UNION ALL SELECT root_id, author, child_id, step + 1 FROM c JOIN own ON own.parent_id = c.event_id AND own.child_pubkey = author WHERE step < 8) SELECT * FROM c) WHERE step > 0", ("own", _CHAIN))
def _(t):
    return graph.authored_chain(t.events.where("kind = 1"), _edges(t))


_ALLOWED = "SELECT parent_id, child_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY created_at, child_id) AS r FROM edges WHERE kind = 1 AND child_pubkey IN (SELECT pubkey FROM ls WHERE score >= 50)) WHERE r = 1"


@query_of("g7_live_chain", "SELECT root_id, event_id, step FROM (WITH RECURSIVE c(root_id, event_id, step) AS (SELECT id, id, 0 FROM ev WHERE kind = 1 UNION ALL SELECT root_id, child_id, step + 1 FROM c JOIN own ON own.parent_id = c.event_id WHERE step < 8) SELECT * FROM c) WHERE step > 0", ("own", _ALLOWED))
def _(t):
    allowed = jobs.scored_actors(t.scores, 50).select(F.col("pubkey").alias("author"))
    return graph.authored_chain(t.events.where("kind = 1"), _edges(t), allowed=allowed, via=F.col("kind") == 1)


@query_of("q5_best_followed_reply", "SELECT viewer, parent_id, child_id FROM (SELECT fe.follower AS viewer, parent_id, child_id, row_number() OVER (PARTITION BY fe.follower, parent_id ORDER BY coalesce(likes, 0) DESC, created_at DESC, child_id DESC) AS r FROM edges JOIN fe ON fe.followed = child_pubkey LEFT JOIN lk ON lk.id = child_id) WHERE r = 1")
def _(t):
    return graph.best_followed_reply(None, _edges(t), _follows(t), jobs.like_counts(t.tags))


@query_of("q6_follow_counts", "SELECT st.pubkey, CAST(coalesce(len(list_distinct(contacts)), 0) AS BIGINT) AS following, CAST(st.followers AS BIGINT) AS followers FROM st LEFT JOIN ct USING (pubkey)")
@query_of("q25_own_profiles", "SELECT st.pubkey, CAST(coalesce(len(list_distinct(contacts)), 0) AS BIGINT) AS following, CAST(st.followers AS BIGINT) AS followers FROM st LEFT JOIN ct USING (pubkey)")
def _(t):
    return people.follow_counts(t.contacts, _user_stats(t))


@query_of("q8_latest_contacts", "SELECT pubkey, CAST(len(list_distinct(contacts)) AS INT) AS n FROM ct")
def _(t):
    return t.contacts.select("pubkey", F.size(F.array_distinct("contacts")).alias("n"))


_SEARCH = "SELECT q AS query, pubkey, score AS relevance, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, created_at DESC, pubkey) AS INT) AS position FROM (SELECT q, pf.pubkey, pf.created_at, CAST(greatest(CASE WHEN lower(name) = q THEN 100 ELSE 0 END, CASE WHEN lower(display_name) = q THEN 98 ELSE 0 END, CASE WHEN lower(nip05) = q THEN 96 ELSE 0 END, CASE WHEN starts_with(lower(name), q) THEN 90 ELSE 0 END, CASE WHEN starts_with(lower(display_name), q) THEN 88 ELSE 0 END, CASE WHEN starts_with(lower(nip05), q) THEN 86 ELSE 0 END, CASE WHEN contains(lower(name), q) THEN 76 ELSE 0 END, CASE WHEN contains(lower(display_name), q) THEN 74 ELSE 0 END, CASE WHEN contains(lower(nip05), q) THEN 72 ELSE 0 END, CASE WHEN contains(lower(lud16), q) THEN 60 ELSE 0 END, CASE WHEN contains(lower(website), q) THEN 50 ELSE 0 END, CASE WHEN contains(lower(about), q) THEN 30 ELSE 0 END, CASE WHEN contains(lower(raw_json), q) THEN 10 ELSE 0 END) AS DOUBLE) AS score FROM pf, (VALUES ('user1'), ('user number 7'), ('about click'), ('site3'), ('u12@')) AS v(q) WHERE contains(lower(concat_ws(' ', name, display_name, nip05, lud16, website, about, raw_json)), q))"


def _search(t):
    q = t.spark.createDataFrame([("user1",), ("user number 7",), ("about click",), ("site3",), ("u12@",)], "query string")
    newest = t.stored("profiles", lambda: profiles(t.events), ("pubkey",))
    postings = t.stored("profile-grams", lambda: people.gram_postings(newest), ("gram", "doc"))
    counts = t.stored("gram-counts", lambda: people.gram_counts(postings), ("gram",))
    return people.search_profiles(q, newest, index=(postings, counts))


@query_of("q9_profile_search", "SELECT * FROM s WHERE position <= 10", ("s", _SEARCH))
def _(t):
    return _search(t)


@query_of("q10_merged_search", "SELECT query, pubkey, CAST(row_number() OVER (PARTITION BY query ORDER BY src, position, pubkey) AS INT) AS position FROM (SELECT query, pubkey, min(src) AS src, arg_min(position, src * 1000 + position) AS position FROM (SELECT query, pubkey, 1 AS src, position FROM s WHERE position <= 10 UNION ALL SELECT 'user1', pubkey, 0, CAST(row_number() OVER (ORDER BY score DESC, pubkey) AS INT) FROM ls QUALIFY row_number() OVER (ORDER BY score DESC, pubkey) <= 4) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query ORDER BY src, position, pubkey) <= 10", ("s", _SEARCH))
def _(t):
    top = jobs.latest_scores(t.scores).orderBy(F.desc("score"), "pubkey").limit(4).withColumn("all", F.lit(1))
    external = latest.ranked(top, ["all"], [F.desc("score"), F.asc("pubkey")], "position").select(F.lit("user1").alias("query"), "pubkey", "position")  # four rows
    return people.merged_search(external, _search(t), 10)


@query_of("q11_author_feed", "SELECT viewer, id FROM (SELECT fe.follower AS viewer, ev.id, row_number() OVER (PARTITION BY fe.follower ORDER BY created_at DESC, id DESC) AS r FROM ev JOIN fe ON fe.followed = ev.pubkey WHERE kind IN (1, 6, 16) AND created_at < TIMESTAMP '2024-01-25') WHERE r <= 100")
def _(t):
    rows = query.between(t.events.where("kind IN (1, 6, 16)"), None, "2024-01-25").select("id", "pubkey", "created_at")
    rows = rows.join(_follows(t).select(F.col("follower").alias("viewer"), F.col("followed").alias("pubkey")), "pubkey")
    return latest.top_per_key(rows, ["viewer"], [F.desc("created_at"), F.desc("id")], 100).select("viewer", "id")


@query_of("q12_feed_items", "SELECT ev.id, CASE WHEN ev.kind = 6 THEN 'repost' ELSE 'note' END AS item, o.id AS original_id, o.content AS original_content FROM ev LEFT JOIN ev o ON ev.kind = 6 AND o.id = ev.tags[1][2] WHERE ev.kind IN (1, 6)")
@query_of("t6_ordering_elements", "SELECT ev.id, CASE WHEN ev.kind = 6 THEN 'repost' ELSE 'note' END AS item, o.id AS original_id, o.content AS original_content FROM ev LEFT JOIN ev o ON ev.kind = 6 AND o.id = ev.tags[1][2] WHERE ev.kind IN (1, 6)")
def _(t):
    item = F.when(F.col("kind") == 6, "repost").otherwise("note")
    rows = t.events.where("kind IN (1, 6)").select("id", item.alias("item"), F.when(F.col("kind") == 6, tg.first_value(F.col("tags"), "e")).alias("_o"))
    return rows.join(t.events.select(F.col("id").alias("original_id"), F.col("content").alias("original_content")), F.col("_o") == F.col("original_id"), "left").drop("_o")


_ROOTS = "SELECT id AS event_id, coalesce(list_filter(tags, lambda t: t[1] = 'e' AND coalesce(t[4], '') = 'root')[1][2], list_filter(tags, lambda t: t[1] = 'e' AND coalesce(t[4], '') <> 'mention')[1][2]) AS next_id FROM ev"


@query_of("q13_roots", "SELECT id, arg_max(event_id, step) AS root_id FROM (WITH RECURSIVE c(id, event_id, step) AS (SELECT id, id, 0 FROM ev UNION ALL SELECT c.id, next_id, step + 1 FROM c JOIN up USING (event_id) WHERE step < 8) SELECT * FROM c) GROUP BY id", ("up", f"SELECT * FROM ({_ROOTS}) WHERE next_id IS NOT NULL AND next_id <> event_id"))
def _(t):
    return graph.resolve_roots(t.events)


_TREE = "SELECT * FROM (WITH RECURSIVE c(node, up, step) AS (SELECT child_id, parent_id, 1 FROM edges UNION ALL SELECT node, parent_id, step + 1 FROM c JOIN edges ON edges.child_id = c.up WHERE step < 16) SELECT * FROM c)"


@query_of("q31_thread_tree", "SELECT node, CAST(coalesce(depth, 0) AS BIGINT) AS depth, coalesce(children, 0) AS children, coalesce(descendants, 0) AS descendants, coalesce(likes, 0) AS likes FROM (SELECT child_id AS node FROM edges UNION SELECT parent_id FROM edges) LEFT JOIN (SELECT node, max(step) AS depth FROM anc GROUP BY 1) USING (node) LEFT JOIN (SELECT up AS node, count(*) AS descendants, count(*) FILTER (step = 1) AS children FROM anc GROUP BY 1) USING (node) LEFT JOIN (SELECT id AS node, likes FROM lk) USING (node)", ("anc", _TREE))
def _(t):
    return graph.thread_tree(_edges(t), jobs.like_counts(t.tags))


def _thread_roots(t):
    return t.events.where("kind = 1 AND size(tags) = 0")


def _threads(t):
    return graph.expand_threads(_thread_roots(t), t.tags)


_EXPAND = "SELECT root_id, event_id, min(level) AS level FROM (WITH RECURSIVE c(root_id, event_id, level) AS (SELECT id, id, 0 FROM ev WHERE kind = 1 AND len(tags) = 0 UNION SELECT root_id, tg.event_id, level + 1 FROM c JOIN tg ON tg.tag_value = c.event_id AND tag_key = 'e' AND tg.kind IN (1, 1111) WHERE level < 8) SELECT * FROM c) GROUP BY 1, 2"
#: To any level: no thread is deeper than there are events.
_EXPAND_ALL = _EXPAND.replace("level < 8", "level < (SELECT count(*) FROM ev)")


@query_of("q14_threads", "SELECT root_id, event_id, CAST(level AS INT) AS level FROM x WHERE level > 0", ("x", _EXPAND))
def _(t):
    return _threads(t)


@query_of(
    "q15_thread_order",
    "SELECT root_id, event_id, CAST(row_number() OVER (PARTITION BY root_id ORDER BY tier, spot, event_id) AS INT) AS position FROM (SELECT * FROM tiers WHERE (root_id, event_id) IN (SELECT (root_id, event_id) FROM tr) QUALIFY row_number() OVER (PARTITION BY root_id, event_id ORDER BY tier, spot) = 1)",
    ("x", _EXPAND_ALL), ("own", _CHAIN), ("rts", "SELECT id, pubkey FROM ev WHERE kind = 1 AND len(tags) = 0"),
    ("tr", "SELECT root_id, event_id, row_number() OVER (PARTITION BY root_id ORDER BY level, event_id) AS place FROM x WHERE level > 0"),
    ("ch", "SELECT root_id, event_id, step FROM (WITH RECURSIVE c(root_id, author, event_id, step) AS (SELECT id, pubkey, id, 0 FROM rts UNION ALL SELECT root_id, author, child_id, step + 1 FROM c JOIN own ON own.parent_id = c.event_id AND own.child_pubkey = author WHERE step < 8) SELECT * FROM c) WHERE step > 0"),
    ("fo", "SELECT rts.id AS root_id, child_id AS event_id FROM rts JOIN edges ON parent_id = rts.id JOIN fe ON fe.follower = rts.pubkey AND fe.followed = child_pubkey LEFT JOIN lk ON lk.id = child_id QUALIFY row_number() OVER (PARTITION BY rts.id ORDER BY coalesce(likes, 0) DESC, edges.created_at DESC, child_id DESC) = 1"),
    ("rk", "SELECT parent_id AS root_id, child_id AS event_id, -epoch(created_at)::BIGINT AS recency, row_number() OVER (PARTITION BY parent_id ORDER BY coalesce(likes, 0) DESC, created_at DESC, child_id DESC) AS position FROM edges LEFT JOIN lk ON lk.id = child_id"),
    ("tiers", "SELECT root_id, event_id, 1 AS tier, step::BIGINT AS spot FROM ch UNION ALL SELECT root_id, event_id, 2, 0 FROM fo UNION ALL SELECT root_id, event_id, 3, position FROM rk WHERE position <= 10 UNION ALL SELECT root_id, event_id, 4, recency FROM rk UNION ALL SELECT root_id, event_id, 5, place FROM tr"),
)
def _(t):
    """Keys are 32 bytes all the way, which sort as their digits do."""
    short = lambda df, *keys: df.withColumns({k: tx.packed(F.col(k)) for k in keys})
    roots, e = short(_thread_roots(t).select("id", "pubkey"), "id", "pubkey"), short(_edges(t), "child_id", "parent_id", "child_pubkey")
    likes, follows = short(jobs.like_counts(t.tags), "target_event_id"), short(_follows(t), "follower", "followed")
    expanded = cut(graph.expand_threads(roots, short(t.tags.select("event_id", "kind", "tag_key", "tag_value"), "event_id", "tag_value"), levels=None), "threads")
    threads = latest.ranked(expanded, ["root_id"], [F.asc("level"), F.asc("event_id")], "place")
    ranked = graph.ranked_replies(e, likes, "likes", "created_at")
    ranked = ranked.select(F.col("parent_id").alias("root_id"), F.col("child_id").alias("event_id"), "position", (-tx.unix(F.col("created_at"))).alias("recency"))
    followed = graph.best_followed_reply(roots.select(F.col("pubkey").alias("viewer"), F.col("id").alias("parent_id")), e, follows, likes)
    followed = followed.select(tx.packed(F.col("parent_id")).alias("root_id"), F.col("child_id").alias("event_id"))
    rows = graph.thread_order(threads, graph.authored_chain(roots, e), followed, ranked)
    return rows.withColumns({k: tx.unpacked(F.col(k)) for k in ("root_id", "event_id")})


@query_of("q16_hydration", "SELECT stats.event_id, likes, replies, coalesce(nullif(display_name, ''), nullif(name, '')) AS author_name, CAST(len(list_filter(tags, lambda t: t[1] = 'q')) AS INT) AS quoted FROM stats JOIN ev ON ev.id = stats.event_id LEFT JOIN pf USING (pubkey)")
def _(t):
    notes = t.events.where("kind = 1")
    stats = jobs.note_stats(notes, t.tags, t.zaps, _edges(t)).select("event_id", "likes", "replies")
    rows = people.decorated(notes.select(F.col("id").alias("event_id"), "pubkey", F.size(tg.quoted_ids(F.col("tags"))).alias("quoted")), profiles(t.events))
    return stats.join(rows, "event_id").select("event_id", "likes", "replies", "author_name", "quoted")


_FEED = """SELECT c.viewer, c.created_at, c.event_id, c.reason, c.actor_pubkey, ev.pubkey AS event_pubkey, ev.kind AS event_kind, coalesce(m.is_reply, false) AS is_reply, coalesce(p.pubkey, '') AS direct_parent_author, th.viewer IS NOT NULL AS replies_viewer_thread, coalesce(ls.score, 0) AS actor_score
 FROM (SELECT * FROM cand WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-22') c JOIN ev ON ev.id = c.event_id
 LEFT JOIN (SELECT event_id, count(*) FILTER (marker IN ('', 'root', 'reply')) > 0 AS is_reply, coalesce(arg_min(tag_value, tag_index) FILTER (marker = 'reply'), arg_max(tag_value, tag_index) FILTER (marker = ''), arg_min(tag_value, tag_index) FILTER (marker = 'root')) AS parent FROM tg WHERE tag_key = 'e' GROUP BY 1) m ON m.event_id = c.event_id
 LEFT JOIN ev p ON p.id = m.parent LEFT JOIN (SELECT DISTINCT tg.event_id, a.pubkey AS viewer FROM tg JOIN ev a ON a.id = tag_value WHERE tag_key = 'e' AND marker IN ('', 'root', 'reply')) th ON th.event_id = c.event_id AND th.viewer = c.viewer
 LEFT JOIN ls ON ls.pubkey = c.actor_pubkey"""


def _feed(t):
    """The feed, built once for the data folder; reads take it from its files."""
    return t.stored("feed", lambda: _built_feed(t), ("viewer", "created_at"))


def _built_feed(t):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return notify.feed(jobs.notification_candidates(t.tags), t.events, t.tags, t.scores, day("2024-01-08"), day("2024-01-22"))


@query_of("m11_notifications_feed", "SELECT * FROM feed", ("feed", _FEED))
@query_of("st10_feed_window", "SELECT * FROM feed", ("feed", _FEED))
def _(t):
    return _feed(t)


@query_of("st10_feed_walker", "SELECT * FROM feed", ("feed", _FEED))
def _(t):
    candidates = cut(jobs.notification_candidates(t.tags), "candidates")
    at = lambda x: F.lit(x.isoformat(" ")).cast("timestamp_ntz")
    build = lambda start, end: notify.feed(candidates, t.events, t.tags, t.scores, at(start), at(end))
    base, cursors = new_path(t.spark, "feed"), notify.FeedCursors()
    for day in (20, 21, 22):  # three ticks: the head moves on, history fills in behind it
        cursors = notify.walk_feed(build, base, cursors, datetime(2024, 1, day), slice_=timedelta(days=3))
    return notify.built_feed(t.spark, base, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in build(datetime(2024, 1, 8), datetime(2024, 1, 9)).schema))


_WINDOW = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY viewer ORDER BY created_at DESC, event_id DESC, reason) AS w FROM feed) WHERE w <= 200"
_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY viewer, reason, actor_pubkey ORDER BY created_at, event_id) AS k FROM win) WHERE reason <> 'follow' OR k = 1"
_PAGE = "SELECT viewer, event_id, reason, CAST(row_number() OVER (PARTITION BY viewer ORDER BY created_at DESC, event_id DESC, reason) AS INT) AS position FROM one WHERE {} QUALIFY row_number() OVER (PARTITION BY viewer ORDER BY created_at DESC, event_id DESC, reason) <= 20"
_STRICT = "(event_kind <> 1 OR NOT is_reply OR replies_viewer_thread) AND (actor_score >= {} OR viewer IN (SELECT pubkey FROM ls WHERE score >= {}))"


@query_of("q17_notifications", _PAGE.format(_STRICT.format(50, 80)), ("feed", _FEED), ("win", _WINDOW), ("one", _FIRST))
def _(t):
    return notify.read(_feed(t), notify.NotificationQuery(limit=20), scores=t.scores).select("viewer", "event_id", "reason", "position")


@query_of("q18_notifications_follows", _PAGE.format("event_kind <> 1 OR NOT is_reply OR direct_parent_author = viewer"), ("feed", "SELECT * FROM (" + _FEED + ") f WHERE (viewer, actor_pubkey) IN (SELECT (follower, followed) FROM fe)"), ("win", _WINDOW), ("one", _FIRST))
def _(t):
    return notify.read(_feed(t), notify.NotificationQuery(policy="FOLLOWS", reply_scope="DIRECT", limit=20), follows=_follows(t)).select("viewer", "event_id", "reason", "position")


@query_of("q19_notification_groups", """SELECT viewer, item, CASE WHEN reason IN ('follow', 'repost', 'reaction', 'zap') AND n >= 2 THEN CASE WHEN reason = 'follow' THEN coalesce(fc.followers, 0) ELSE n END ELSE 1 END AS total, reason IN ('follow', 'repost', 'reaction', 'zap') AND n >= 2 AS is_group FROM
 (SELECT viewer, reason, CASE WHEN reason = 'follow' THEN 'follow' WHEN reason IN ('repost', 'reaction', 'zap') THEN reason || ':' || coalesce(nullif(ev.tags[1][2], ''), 'profile') ELSE 'single:' || cand.event_id END AS item, count(*) AS n, max(cand.created_at) AS last_at, arg_max(cand.event_id, (cand.created_at, cand.event_id)) AS eid FROM cand JOIN ev ON ev.id = cand.event_id GROUP BY 1, 2, 3) g LEFT JOIN fc ON fc.pubkey = viewer QUALIFY row_number() OVER (PARTITION BY viewer ORDER BY last_at DESC, eid DESC, item) <= 50""")
def _(t):
    first = t.events.select(F.col("id").alias("event_id"), tg.first_value(F.col("tags"), "e").alias("target_id"))
    return notify.grouped(jobs.notification_candidates(t.tags), first, jobs.follower_counts(t.contacts)).select("viewer", "item", "total", "is_group")


@query_of("q20_messages", "SELECT viewer, id FROM (SELECT *, row_number() OVER (PARTITION BY viewer ORDER BY created_at DESC, id DESC) AS r FROM (SELECT pubkey AS viewer, id, created_at FROM ev WHERE kind IN (4, 1059) UNION SELECT tag_value, event_id, created_at FROM tg WHERE kind IN (4, 1059) AND tag_key = 'p')) WHERE r <= 500")
def _(t):
    return people.messages(t.events, t.tags).select("viewer", "id")


@query_of("q21_conversations", "SELECT least(pubkey, tag_value) AS one, greatest(pubkey, tag_value) AS other, event_id AS id, pubkey AS sender FROM tg WHERE kind = 4 AND tag_key = 'p'")
def _(t):
    return people.conversations(t.events).select("one", "other", "id", "sender")


@query_of("q22_own_history", "SELECT pubkey, id FROM ev WHERE kind IN (1, 1111) AND len(list_filter(tags, lambda t: t[1] = 'e')) > 0")
def _(t):
    return query.history(t.events, "replies").select("pubkey", "id")


@query_of("q23_social_graph", """SELECT pubkey, max(CASE WHEN kind = 3 THEN array_to_string(list_transform(list_filter(tags, lambda t: t[1] = 'p'), lambda t: t[2]), ',') END) AS follows, max(CASE WHEN kind = 10000 THEN array_to_string(list_transform(list_filter(tags, lambda t: t[1] = 'p'), lambda t: t[2]), ',') END) AS mutes,
 max(CASE WHEN kind = 10002 THEN array_to_string(list_transform(list_filter(tags, lambda t: t[1] = 'r'), lambda t: t[2] || CASE WHEN coalesce(t[3], '') <> 'write' THEN '+r' ELSE '' END || CASE WHEN coalesce(t[3], '') <> 'read' THEN '+w' ELSE '' END), ',') END) AS relays FROM (SELECT *, row_number() OVER (PARTITION BY pubkey, kind ORDER BY created_at DESC, id) AS r FROM ev WHERE kind IN (3, 10000, 10002)) WHERE r = 1 GROUP BY 1""")
def _(t):
    return people.social_graph(t.events)


@query_of("q24_seen_until", "SELECT pubkey, CAST(content ->> '$.seenUntil' AS BIGINT) AS seen_until FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, id DESC) AS r FROM ev WHERE kind = 30078 AND tags[1][2] = 'seen') WHERE r = 1")
def _(t):
    return people.seen_until(t.events)


@query_of("q28_profile_summaries", "SELECT pf.pubkey, name, CAST(coalesce(len(list_distinct(contacts)), 0) AS BIGINT) AS following, CAST(coalesce(st.followers, 0) AS BIGINT) AS followers, f.at AS created_at FROM pf LEFT JOIN st USING (pubkey) LEFT JOIN ct USING (pubkey) JOIN (SELECT pubkey, min(created_at) AS at FROM ev GROUP BY 1) f USING (pubkey)")
def _(t):
    return people.profile_summaries(profiles(t.events), t.events, people.follow_counts(t.contacts, _user_stats(t)))


@query_of("q29_thread_statistics", "SELECT root_id, count(*) AS events, count(DISTINCT pubkey) AS authors, count(*) FILTER (kind = 1111) AS comments FROM x JOIN ev ON ev.id = x.event_id WHERE level > 0 GROUP BY 1", ("x", _EXPAND))
def _(t):
    e = t.events.select(F.col("id").alias("event_id"), "pubkey", "kind")
    return _threads(t).join(e, "event_id").groupBy("root_id").agg(F.count("*").alias("events"), F.count_distinct("pubkey").alias("authors"), F.count_if(F.col("kind") == 1111).alias("comments"))


@query_of("q30_dependent_keys", "SELECT 'event' AS what, tag_value AS key FROM tg WHERE tag_key IN ('e', 'q') AND kind IN (1, 6) UNION SELECT 'pubkey', tag_value FROM tg WHERE tag_key = 'p' AND kind IN (1, 6) UNION SELECT 'pubkey', pubkey FROM ev WHERE kind IN (1, 6)")
def _(t):
    return graph.dependent_keys(t.events.where("kind IN (1, 6)"), t.tags.where("kind IN (1, 6)"))


# -- reviews -------------------------------------------------------------------------------------

_RV = "SELECT * FROM (SELECT lower(rtrim(trim(' https://Mint-' || (o_orderkey % n) || '.example/'), '/')) AS mint, sha256('u' || o_custkey) AS reviewer, sha256('r' || o_orderkey) AS event_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderpriority[1] AS DOUBLE) END AS score, o_orderdate AS created_at, row_number() OVER (PARTITION BY o_orderkey % n, o_custkey ORDER BY o_orderdate DESC, sha256('r' || o_orderkey) DESC) AS r FROM orders, (SELECT max(s_suppkey) + 1 AS n FROM supplier)) WHERE r = 1"
_RS = "SELECT mint, avg(score) AS average, count(*) AS reviews, count(*) FILTER (score IS NULL) AS favourites FROM rv GROUP BY 1"


@query_of("q26_mint_reviews", "SELECT mint, reviewer, event_id, score, created_at FROM rv", ("rv", _RV))
def _(t):
    return reviews.mint_reviews(t.reviews)


@query_of("a20_mint_scores", "SELECT mint, round(average, 9) AS average, reviews, favourites FROM rs", ("rv", _RV), ("rs", _RS))
def _(t):
    return reviews.mint_scores(reviews.mint_reviews(t.reviews)).withColumn("average", F.round("average", 9))


_LB = """SELECT mint, average, coalesce(reviews, 0) AS reviews, coalesce(state, '') = 'OK' AS green, up AS uptime, 0.4::DOUBLE * up + 0.3::DOUBLE * coalesce(average, 0) / 5 + 0.2::DOUBLE * least(log10(1 + coalesce(reviews, 0)) / 2, 1) + 0.1::DOUBLE * least(log10(1 + coalesce(s_suppkey * 11 % 5000, 0)) / 4, 1) AS score
 FROM (SELECT coalesce(rs.mint, a.mint) AS mint, average, reviews, state, s_suppkey, CASE WHEN coalesce(m + e, 0) > 0 THEN m::DOUBLE / (m + e) ELSE 0 END AS up FROM rs FULL JOIN (SELECT 'https://mint-' || s_suppkey || '.example' AS mint, CASE WHEN s_suppkey % 5 = 0 THEN 'ERROR' ELSE 'OK' END AS state, s_suppkey * 3 % 100 + s_suppkey * 7 % 50 AS m, s_suppkey % 4 AS e FROM supplier WHERE s_suppkey % 10 <> 9) a ON a.mint = rs.mint LEFT JOIN (SELECT 'https://mint-' || s_suppkey || '.example' AS fm, s_suppkey FROM supplier) f ON f.fm = coalesce(rs.mint, a.mint))"""


@query_of("q27_leaderboard", "SELECT mint, reviews, green, round(uptime, 6) AS uptime, round(score, 6) AS score FROM lb", ("rv", _RV), ("rs", _RS), ("lb", _LB))
@query_of("j12_reviews_and_audits", "SELECT mint, reviews, green, round(uptime, 6) AS uptime, round(score, 6) AS score FROM lb", ("rv", _RV), ("rs", _RS), ("lb", _LB))
def _(t):
    from socialspark.sources.tables import table

    f = table(t.spark, t.sf_dir, "supplier").selectExpr("'https://mint-' || s_suppkey || '.example' AS mint", "s_suppkey * 11 % 5000 AS followers")
    lb = reviews.leaderboard(reviews.mint_scores(reviews.mint_reviews(t.reviews)), t.audits, f)
    return lb.select("mint", "reviews", "green", F.round("uptime", 6).alias("uptime"), F.round("score", 6).alias("score"))


@query_of("s13_audit_units", "SELECT 'https://mint-' || s_suppkey || '.example' AS url, 'sat,usd' AS units, 'op' || s_suppkey AS operator FROM supplier WHERE s_suppkey % 10 <> 9")
def _(t):
    return audit_units(t.audits).select("url", F.concat_ws(",", "units").alias("units"), "operator")


# -- quality -------------------------------------------------------------------------------------

_ANY = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
_SUM = lambda words: "(" + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words) + ")"
_TOK = "SELECT ev.id, ev.pubkey, d.text, lower(d.text) AS low, list_filter(regexp_split_to_array(lower(d.text), '[^\\p{L}\\p{Nd}]+'), lambda x: strlen(x) >= 2) AS tok FROM ev JOIN documents d ON d.doc_id = ev.event_id WHERE ev.kind IN (1, 1111) AND len(list_filter(tags, lambda t: lower(t[1]) = 'e' AND len(t) >= 2)) > 0"
_QL1 = f"""SELECT *, len(tok) AS n, CASE WHEN len(tok) > 0 THEN len(list_distinct(tok))::DOUBLE / len(tok) ELSE 0 END AS u, CASE WHEN len(tok) > 0 THEN list_max(map_values(list_histogram(tok)))::DOUBLE / len(tok) ELSE 0 END AS top, {_SUM(enrich.POSITIVE)} AS p, {_SUM(enrich.NEGATIVE)} AS g FROM tok"""
_QL2 = f"""SELECT *, CASE WHEN n = 0 THEN trim(text) <> '' ELSE n <= 3 AND {_ANY(enrich.REACTIONS)} END AS react, least(0.55::DOUBLE + CASE WHEN n >= 4 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN {_ANY(enrich.REASONS)} THEN 0.15::DOUBLE ELSE 0 END, 1) AS rel, least(least(n / 36.0::DOUBLE, 1) * 0.65::DOUBLE + u * 0.35::DOUBLE, 1) AS inf0, least(0.35::DOUBLE + u * 0.65::DOUBLE, 1) AS nov0, greatest(least(0.65::DOUBLE + CASE WHEN p + g > 0 THEN (p - g)::DOUBLE / (p + g) ELSE 0 END * 0.2::DOUBLE, 1), 0) AS con0 FROM ql1"""
_QL3 = f"""SELECT *, inf0 * CASE WHEN react THEN 0.25 ELSE 1 END * CASE WHEN top > 0.45 THEN 0.75 ELSE 1 END * CASE WHEN {_ANY(enrich.LURES)} THEN 0.5 ELSE 1 END AS inf, nov0 * CASE WHEN top > 0.45 THEN 0.45 ELSE 1 END * CASE WHEN {_ANY(enrich.LURES)} THEN 0.6 ELSE 1 END AS nov, con0 * CASE WHEN react THEN 0.75 ELSE 1 END * CASE WHEN {_ANY(enrich.INSULTS)} THEN 0.25 ELSE 1 END AS con FROM ql2"""
_QL = (("tok", _TOK), ("ql1", _QL1), ("ql2", _QL2), ("ql3", _QL3))


@query_of("e1_contribution_quality", "SELECT id AS event_id, round(rel, 6) AS reply_relevance, round(inf, 6) AS reply_informativeness, round(nov, 6) AS reply_novelty, round(con, 6) AS reply_constructiveness, round(greatest(least(rel * 0.25 + inf * 0.35 + nov * 0.15 + con * 0.25, 1), 0), 6) AS contribution_quality FROM ql3", *_QL)
def _(t):
    return enrich.quality_columns(t.replies_with_text).select(F.col("id").alias("event_id"), *[F.round(m, 6).alias(m) for m in enrich.METRICS])


@query_of("e2_sentiment", "SELECT id, round(CASE WHEN p + g > 0 THEN (p - g)::DOUBLE / (p + g) ELSE 0 END, 6) AS sentiment FROM ql1", *_QL[:2])
def _(t):
    return t.replies_with_text.where(tg.is_reply(F.col("kind"), F.col("tags"))).select("id", F.round(enrich.sentiment(F.lower("content")), 6).alias("sentiment"))


@query_of("e3_replies", "SELECT id FROM ev WHERE kind IN (1, 1111) AND len(list_filter(tags, lambda t: lower(t[1]) = 'e' AND len(t) >= 2)) > 0")
def _(t):
    return t.events.where(tg.is_reply(F.col("kind"), F.col("tags"))).select("id")


def _metrics(t):
    """Two versions of a metric for every note: a plain stand-in for stored annotations."""
    return t.events.where("kind = 1").selectExpr("id AS event_id", "'contribution_quality' AS metric", "explode(array(0, 1)) AS v", "event_id AS n").selectExpr("event_id", "metric", "cast((n * 7 + v * 3) % 100 as double) / 100 AS value", "v AS computed_at")


_MV = "SELECT id AS event_id, CAST((event_id * 7 + 3) % 100 AS DOUBLE) / 100 AS value FROM ev WHERE kind = 1"


@query_of("e4_newest_metric", "SELECT event_id, value FROM mv WHERE event_id IN (SELECT parent_id FROM edges)", ("mv", _MV))
def _(t):
    return enrich.newest_metrics(_metrics(t), "contribution_quality", _edges(t).select(F.col("parent_id").alias("id")))


@query_of("e5_score_rows", "SELECT pubkey, score, followers FROM sc WHERE score > 50")
def _(t):
    p = t.scores.selectExpr("source", "pubkey", "CASE WHEN score > 50 THEN to_json(named_struct('score', score, 'followers', followers, 'nodes', nodes)) ELSE '{\"nodes\":1}' END AS payload", "fetched_at")
    return enrich.score_rows(p).select("pubkey", "score", "followers")


# -- references and rankings ---------------------------------------------------------------------


@query_of("g1_forward_references", "SELECT event_id AS source_id, tag_value AS target_id FROM tg WHERE tag_key = 'e' AND kind IN (1, 1111) AND tag_value IN (SELECT id FROM ev) GROUP BY 1, 2")
def _(t):
    return graph.forward_references(t.events.where("kind IN (1, 1111)"), t.events, TagPredicate("e"), 10).select("source_id", "target_id")


_SEL = "SELECT id, coalesce(list_filter(tags, lambda t: t[1] = 'e' AND coalesce(t[4], '') = 'reply')[1][2], list_filter(tags, lambda t: t[1] = 'e')[-1][2]) AS target FROM ev WHERE kind IN (1, 1111) AND len(list_filter(tags, lambda t: t[1] = 'e')) > 0"


def _selected(t):
    sel = tg.selected_refs(F.col("tags"), [TagPredicate("e", markers=("reply",))], "LAST", F.col("id"), 1)
    return t.events.where("kind IN (1, 1111)").select("id", F.get(sel, F.lit(0)).alias("target")).where("target IS NOT NULL")


@query_of("g2_selected_reference", "SELECT id, target FROM sel WHERE target <> id", ("sel", _SEL))
def _(t):
    return _selected(t)


@query_of("g3_reference_walk", "SELECT source_id, event_id, CAST(step AS INT) AS step FROM (WITH RECURSIVE c(source_id, event_id, step) AS (SELECT id, id, 0 FROM ev WHERE kind IN (1, 1111) UNION ALL SELECT source_id, target, step + 1 FROM c JOIN sel ON sel.id = c.event_id WHERE step < 8) SELECT * FROM c) WHERE step > 0", ("sel", _SEL))
def _(t):
    return graph.walk(t.events.where("kind IN (1, 1111)"), _selected(t).withColumnsRenamed({"id": "event_id", "target": "next_id"}))


@query_of("g4_referenced_by", "SELECT tag_value AS parent_id, event_id, CAST(r AS INT) AS position FROM refs WHERE r <= 20 AND tag_value IN (SELECT id FROM ev WHERE kind = 1)", ("refs", _REFS))
def _(t):
    return graph.referenced_by(t.events.where("kind = 1"), t.tags, limit=20)


@query_of("g5_ranked_referenced_by", "SELECT parent_id, event_id, CAST(k AS INT) AS rank FROM (SELECT tag_value AS parent_id, event_id, row_number() OVER (PARTITION BY tag_value ORDER BY coalesce(likes, 0) DESC, r) AS k FROM refs LEFT JOIN lk ON lk.id = event_id WHERE r <= 20 AND tag_value IN (SELECT id FROM ev WHERE kind = 1)) WHERE k <= 3", ("refs", _REFS))
def _(t):
    found = graph.referenced_by(t.events.where("kind = 1"), t.tags, limit=20).join(jobs.like_counts(t.tags).select(F.col("target_event_id").alias("event_id"), "likes"), "event_id", "left")
    return latest.top_per_key(found, ["parent_id"], [F.desc(F.coalesce("likes", F.lit(0))), F.asc("position")], 3, name="rank").select("parent_id", "event_id", "rank")


@query_of("g6_aggregate_referenced_by", "SELECT tag_value AS target_id, kind, count(*) AS n, count(DISTINCT pubkey) AS authors FROM refs WHERE r <= 50 AND tag_value IN (SELECT id FROM ev WHERE kind = 1) GROUP BY 1, 2", ("refs", _REFS))
def _(t):
    from socialspark.operators.aggregate import references_per_target

    return references_per_target(t.events.where("kind = 1"), t.tags, newest=50, dims=("kind",), metrics=(("n", "COUNT", "event_id"), ("authors", "COUNT_DISTINCT", "pubkey")))


@query_of("g8_same_author", "SELECT pubkey, id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, id DESC) AS r FROM ev WHERE kind = 1 AND pubkey IN (SELECT pubkey FROM ev WHERE kind = 4)) WHERE r <= 4")
def _(t):
    return graph.same_author(t.events, t.events.where("kind = 4"), (1,), 4)


def _features(t):
    """The feature table, built once for the data folder; rankings read it from its files."""
    return t.stored("features", lambda: _built_features(t), ("kind", "created_at"))


def _built_features(t):
    targets = jobs.engaged_targets(t.tags, t.zaps, t.as_of - F.expr("INTERVAL 10 DAYS"))
    edges = _edges(t)
    real = jobs.engagement_real(targets, t.tags, t.zaps, edges, t.events, t.scores)
    stats = jobs.note_stats(targets.select(F.col("event_id").alias("id")), t.tags, t.zaps, edges)
    newest = _metrics(t).where("computed_at = 1").select("event_id", "metric", "value")
    return jobs.rank_features(real, stats, t.events, t.scores, _user_stats(t), newest)


_FT = "SELECT realc.event_id, ev.pubkey, ev.kind, ev.created_at, coalesce(lk.likes, 0) AS raw_likes, CAST(coalesce(zt.sats, 0) AS BIGINT) AS raw_sats, real_likes, real_reposts, real_replies, real_quotes, real_zap_sats, real_actors, coalesce(ls.score, 0) AS author_score, CAST(coalesce(st.followers, 0) AS BIGINT) AS author_followers, coalesce(mv.value, 0) AS contribution_quality FROM realc JOIN ev ON ev.id = realc.event_id LEFT JOIN lk ON lk.id = ev.id LEFT JOIN zt ON zt.id = ev.id LEFT JOIN ls ON ls.pubkey = ev.pubkey LEFT JOIN st ON st.pubkey = ev.pubkey LEFT JOIN mv ON mv.event_id = ev.id"


@query_of("m9_note_rank_features", "SELECT * FROM ft", ALL_TARGETS, ("mv", _MV), ("ft", _FT))
@query_of("j4_feature_assembly", "SELECT * FROM ft", ALL_TARGETS, ("mv", _MV), ("ft", _FT))
def _(t):
    return _features(t).select("event_id", "pubkey", "kind", "created_at", "raw_likes", "raw_sats", "real_likes", "real_reposts", "real_replies", "real_quotes", "real_zap_sats", "real_actors", "author_score", "author_followers", "contribution_quality")


@query_of("st11_rollup_tick", "SELECT * FROM ft", ALL_TARGETS, ("mv", _MV), ("ft", _FT))
def _(t):
    since = t.as_of - F.expr("INTERVAL 10 DAYS")
    newest = _metrics(t).where("computed_at = 1").select("event_id", "metric", "value")
    stages = {
        "edges": lambda d: jobs.reply_edges(t.tags),
        "targets": lambda d: jobs.engaged_targets(t.tags, t.zaps, since),
        "engagement": lambda d: jobs.engagement_real(d["targets"], t.tags, t.zaps, d["edges"], t.events, t.scores),
        "users": lambda d: _user_stats(t),
        "features": lambda d: jobs.rank_features(d["engagement"], jobs.note_stats(d["targets"].select(F.col("event_id").alias("id")), t.tags, t.zaps, d["edges"]), t.events, t.scores, d["users"], newest),
    }
    done = jobs.run_stages(t.spark, stages, new_path(t.spark, "tick"))
    return done["features"].select("event_id", "pubkey", "kind", "created_at", "raw_likes", "raw_sats", "real_likes", "real_reposts", "real_replies", "real_quotes", "real_zap_sats", "real_actors", "author_score", "author_followers", "contribution_quality")


_WEIGHTS = {"likes": 1.0, "replies": 2.0, "reposts": 1.5, "quotes": 1.2, "zap_sats": 0.3, "actors": 0.5, "author_score": 0.02, "quality": 1.0, "recency": 3.0}
_SCORE = "ln(1.0::DOUBLE + real_likes) + 2.0::DOUBLE * ln(1.0::DOUBLE + real_replies) + 1.5::DOUBLE * ln(1.0::DOUBLE + real_reposts) + 1.2::DOUBLE * ln(1.0::DOUBLE + real_quotes) + 0.3::DOUBLE * ln(1.0::DOUBLE + real_zap_sats) + 0.5::DOUBLE * real_actors + 0.02::DOUBLE * CASE WHEN author_followers >= 2 THEN author_score ELSE 0 END + contribution_quality + 3.0::DOUBLE * pow(0.5::DOUBLE, greatest(epoch(as_of) - epoch(created_at), 0) / 86400.0::DOUBLE)"


@query_of("r1_feature_ranking", f"SELECT event_id, pubkey, round({_SCORE}, 6) AS score FROM ft, bnd WHERE kind = 1 ORDER BY {_SCORE} DESC, created_at DESC, event_id DESC LIMIT 100", ALL_TARGETS, ("mv", _MV), ("ft", _FT))
@query_of("t4_rank_order", f"SELECT event_id, pubkey, round({_SCORE}, 6) AS score FROM ft, bnd WHERE kind = 1 ORDER BY {_SCORE} DESC, created_at DESC, event_id DESC LIMIT 100", ALL_TARGETS, ("mv", _MV), ("ft", _FT))
def _(t):
    s = ranking.feature_scores(_features(t).where("kind = 1"), _WEIGHTS, t.as_of, min_followers=2)
    return ranking.top_scores(s, 100).select("event_id", "pubkey", F.round("score", 6).alias("score"))


@query_of("r2_reference_ranking", "SELECT id, likes AS score FROM (SELECT ev.id, coalesce(likes, 0) AS likes, created_at FROM ev LEFT JOIN lk USING (id) WHERE kind = 1) ORDER BY likes DESC, id LIMIT 100")
def _(t):
    return ranking.by_references(t.events.where("kind = 1"), t.tags).orderBy(F.desc("score"), "id").limit(100)


_TERMS = (ranking.Term("references", "likes", 1.0, "LOG1P"), ranking.Term("references", "replies", 0.5), ranking.Term("author_score", "reputation", 0.1, min_followers=300, fallback=5.0), ranking.Term("metric", "contribution_quality", 2.0), ranking.Term("field", "created_at", 4.0, "RECENCY_HALFLIFE", 172_800.0))
_W3 = """SELECT ev.id, ev.pubkey, ev.created_at, ln(1.0::DOUBLE + coalesce(a.c, 0)) + 0.5::DOUBLE * coalesce(b.c, 0) + 0.1::DOUBLE * coalesce(CASE WHEN ls.followers >= 300 THEN ls.score END, 5) + 2.0::DOUBLE * coalesce(mv.value, 0) + 4.0::DOUBLE * pow(0.5::DOUBLE, greatest(epoch(as_of) - epoch(ev.created_at), 0) / 172800.0::DOUBLE) AS score
 FROM ev JOIN bnd ON true LEFT JOIN (SELECT tag_value AS id, count(DISTINCT pubkey) AS c FROM tg WHERE tag_key = 'e' AND kind = 7 GROUP BY 1) a USING (id) LEFT JOIN (SELECT tag_value AS id, count(DISTINCT pubkey) AS c FROM tg WHERE tag_key = 'e' AND kind IN (1, 1111) GROUP BY 1) b USING (id) LEFT JOIN ls ON ls.pubkey = ev.pubkey LEFT JOIN mv ON mv.event_id = ev.id WHERE ev.kind = 1"""


def _weighted(t):
    assert ranking.route(_TERMS, True) == "features" and ranking.route(_TERMS, False) == "live"
    newest = _metrics(t).where("computed_at = 1").select("event_id", "metric", "value")
    return ranking.weighted_scores(t.events.where("kind = 1").select("id", "pubkey", "created_at"), _TERMS, t.tags, jobs.latest_scores(t.scores), newest, t.as_of)


@query_of("r3_weighted_scores", "SELECT id, round(score, 6) AS score FROM w", ("mv", _MV), ("w", _W3))
@query_of("r4_live_ranking", "SELECT id, round(score, 6) AS score FROM w", ("mv", _MV), ("w", _W3))
def _(t):
    return _weighted(t).select("id", F.round("score", 6).alias("score"))


@query_of("r5_boosted", "SELECT fe.follower AS viewer, w.id, round(score + 10, 6) AS score FROM w JOIN fe ON fe.followed = w.pubkey", ("mv", _MV), ("w", _W3))
def _(t):
    return ranking.boosted_per_viewer(_weighted(t), _follows(t), 10.0).select("viewer", "id", F.round("score", 6).alias("score"))


_GLOBAL = "ln(1.0::DOUBLE + real_likes) + 0.5::DOUBLE * ln(1.0::DOUBLE + real_replies) + 0.1::DOUBLE * CASE WHEN author_followers >= 2 THEN author_score ELSE 0 END + 2.0::DOUBLE * contribution_quality + 4.0::DOUBLE * pow(0.5::DOUBLE, greatest(epoch(as_of) - epoch(created_at), 0) / 172800.0::DOUBLE)"


@query_of("r4_routed_rankings", f"SELECT 'global' AS request, 'features' AS plan, event_id AS id, round({_GLOBAL}, 6) AS score FROM ft, bnd WHERE kind = 1 UNION ALL SELECT 'personal', 'live', id, round(score, 6) FROM w UNION ALL SELECT 'unmapped', 'live', ev.id, round(coalesce(z.c, 0), 6) FROM ev LEFT JOIN (SELECT tag_value AS id, count(DISTINCT pubkey) AS c FROM tg WHERE tag_key = 'e' AND kind = 9735 GROUP BY 1) z USING (id) WHERE ev.kind = 1", ALL_TARGETS, ("mv", _MV), ("ft", _FT), ("w", _W3))
def _(t):
    shared = tuple(replace(x, min_followers=2) if x.source == "author_score" else x for x in _TERMS)
    requests = {"global": (shared, True), "personal": (_TERMS, False), "unmapped": ((ranking.Term("references", "zaps", 1.0),), True)}
    newest = _metrics(t).where("computed_at = 1").select("event_id", "metric", "value")
    out = None
    for name, (terms, is_global) in requests.items():
        plan = ranking.route(terms, is_global)
        if plan == "features":
            weights, half, least = ranking.feature_weights(terms)
            rows = ranking.feature_scores(_features(t).where("kind = 1"), weights, t.as_of, half, least).withColumnRenamed("event_id", "id")
        else:
            rows = ranking.weighted_scores(t.events.where("kind = 1").select("id", "pubkey", "created_at"), terms, t.tags, jobs.latest_scores(t.scores), newest, t.as_of)
        rows = rows.select(F.lit(name).alias("request"), F.lit(plan).alias("plan"), "id", F.round("score", 6).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query_of("r6_jittered", "SELECT id, round(score + CAST(CAST('0x' || substr(sha256(id || 'z2'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * 0.15, 6) AS score FROM w", ("mv", _MV), ("w", _W3))
def _(t):
    return ranking.jittered(_weighted(t), "z", 2).select("id", F.round("score", 6).alias("score"))


@query_of("r7_per_viewer", "SELECT viewer, id, CAST(r AS INT) AS rank FROM (SELECT viewer, id, row_number() OVER (PARTITION BY viewer ORDER BY score DESC, created_at DESC, id DESC) AS r FROM (SELECT v.follower AS viewer, pool.id, pool.created_at, pool.score + CASE WHEN fe.followed IS NOT NULL THEN 10 ELSE 0 END AS score FROM (SELECT DISTINCT follower FROM fe) v, pool LEFT JOIN fe ON fe.follower = v.follower AND fe.followed = pool.pubkey)) WHERE r <= 10", ("mv", _MV), ("w", _W3), ("pool", "SELECT * FROM w ORDER BY score DESC, created_at DESC, id DESC LIMIT 250"))
def _(t):
    pool = cut(_weighted(t).orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")).limit(250), "pool")
    return ranking.per_viewer(pool, _follows(t), 10.0, 10)


# -- retention -----------------------------------------------------------------------------------


@query_of("rt1_prune_kinds", "SELECT CAST(kind AS INT) AS kind, count(*) AS removed FROM ev WHERE kind NOT IN (0, 1, 3, 6, 7) GROUP BY 1")
def _(t):
    return retention.prune_kinds(t.events, (0, 1, 3, 6, 7))[1]


@query_of("rt1_cascade", "SELECT event_id, tag_index FROM tg WHERE kind IN (0, 1, 3, 6, 7)")
def _(t):
    return retention.cascade(t.tags, retention.prune_kinds(t.events, (0, 1, 3, 6, 7))[0]).select("event_id", "tag_index")


@query_of("rt2_keep_latest", "SELECT id FROM ev WHERE kind NOT IN (0, 3, 10050, 10051) UNION ALL SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY kind, pubkey ORDER BY created_at DESC, id DESC) AS r FROM ev WHERE kind IN (0, 3, 10050, 10051)) WHERE r = 1")
def _(t):
    return retention.keep_latest(t.events).select("id")


@query_of("rt3_keep_latest_address", "SELECT id FROM ev WHERE kind <> 30078 UNION ALL SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY pubkey, tags[1][2] ORDER BY created_at DESC, id DESC) AS r FROM ev WHERE kind = 30078) WHERE r = 1")
def _(t):
    return retention.keep_latest(t.events, retention.LATEST_PER_ADDRESS, per_address=True).select("id")


def _silent(t):
    counters = [jobs.like_counts(t.tags), jobs.repost_counts(t.tags), jobs.quote_counts(t.tags), jobs.zap_totals(t.zaps), jobs.direct_reply_counts(_edges(t))]
    return retention.drop_silent_posts(t.events, counters, t.as_of, days=10)


_SILENT = "kind = 1 AND created_at < as_of - INTERVAL 10 DAY AND id NOT IN (SELECT event_id FROM acts)"


@query_of("rt4_silent_posts", f"SELECT id FROM ev, bnd WHERE NOT ({_SILENT})")
def _(t):
    return _silent(t).select("id")


@query_of("rt5_report", f"SELECT 'latest' AS rule, count(*) - count(*) FILTER (r = 1 OR kind NOT IN (0, 3)) AS matched, count(*) - count(*) FILTER (r = 1 OR kind NOT IN (0, 3)) >= 100 AS acts FROM (SELECT *, row_number() OVER (PARTITION BY kind, pubkey ORDER BY created_at DESC, id DESC) AS r FROM ev) UNION ALL SELECT 'silent', count(*), count(*) >= 100 FROM ev, bnd WHERE {_SILENT}")
def _(t):
    return retention.report(t.events, {"latest": retention.keep_latest(t.events), "silent": _silent(t)}, 100)


@query_of("st12_lifetimes", "SELECT viewer, event_id FROM cand, bnd WHERE created_at > as_of - INTERVAL 14 DAY")
def _(t):
    return retention.alive(jobs.notification_candidates(t.tags), "feed", t.as_of, "created_at").select("viewer", "event_id")


@query_of("st5_exempt_authors", "SELECT pubkey FROM ls WHERE score >= 90 UNION SELECT unnest(contacts) FROM ct WHERE pubkey IN (SELECT pubkey FROM ls WHERE score >= 90)")
def _(t):
    exempt = ExemptAuthors(lambda: jobs.exempt_authors(jobs.scored_actors(t.scores, 90), t.contacts, t.events))
    exempt.refresh()
    return exempt.copy


@query_of("st6_viewer_sightings", "SELECT pubkey, max(created_at) AS last_seen FROM ev WHERE kind IN (3, 7) GROUP BY 1")
def _(t):
    return jobs.viewer_sightings(t.events.where("kind IN (3, 7)").select("pubkey", F.col("created_at").alias("seen_at")), t.as_of)


# -- expressions ---------------------------------------------------------------------------------


@query_of("x_event_expressions", "SELECT id, CASE WHEN kind = 3 THEN 'follow' WHEN kind = 6 THEN 'repost' WHEN kind = 7 THEN 'reaction' WHEN kind = 9735 THEN 'zap' WHEN kind IN (1, 1111) AND len(list_filter(tags, lambda t: t[1] = 'e')) > 0 THEN 'reply' WHEN kind = 1 AND len(list_filter(tags, lambda t: t[1] = 'q')) > 0 THEN 'quote' WHEN kind IN (1, 1111) THEN 'mention' ELSE 'other' END AS reason, CASE WHEN kind IN (1, 1111) THEN coalesce(list_filter(tags, lambda t: t[1] = 'e' AND coalesce(t[4], '') = 'reply')[1][2], list_filter(tags, lambda t: t[1] = 'e' AND coalesce(t[4], '') = '')[-1][2], list_filter(tags, lambda t: t[1] = 'e')[1][2]) END AS parent FROM ev")
def _(t):
    k, g = F.col("kind"), F.col("tags")
    return t.events.select("id", tg.notification_reason(k, g, F.lit("other")).alias("reason"), F.when(k.isin(1, 1111), tg.direct_parent(g)).alias("parent"))


@query_of("x_tokens", "SELECT id, CAST(len(tok) AS INT) AS n, CAST(len(list_distinct(tok)) AS INT) AS distinct_tokens, round(CASE WHEN len(tok) > 0 THEN list_max(map_values(list_histogram(tok)))::DOUBLE / len(tok) ELSE 0 END, 6) AS top FROM tok", _QL[0])
def _(t):
    tok = tx.tokens(F.col("content"))
    return t.replies_with_text.where(tg.is_reply(F.col("kind"), F.col("tags"))).select("id", F.size(tok).alias("n"), F.size(F.array_distinct(tok)).alias("distinct_tokens"), F.round(tx.top_share(tok), 6).alias("top"))


@query_of("x_numbers", "SELECT event_id, round(100.0::DOUBLE * (1.0::DOUBLE - pow(0.24::DOUBLE / (1000.0::DOUBLE * value / 1000.0::DOUBLE + 0.24::DOUBLE), 0.38::DOUBLE)), 2) AS score, round(pow(0.5::DOUBLE, greatest(epoch(as_of) - epoch(date_trunc('second', ts)), 0) / 86400.0::DOUBLE), 6) AS decay FROM events, bnd WHERE value > 0")
def _(t):
    from socialspark.sources.tables import table

    e = table(t.spark, t.sf_dir, "events").where("value > 0")
    return e.select("event_id", tx.pagerank_score(F.col("value") / F.lit(1000.0), F.lit(1000)).alias("score"), F.round(tx.half_life(tx.unix(t.as_of) - tx.unix(F.date_trunc("second", "ts").cast("timestamp_ntz")), 86_400.0), 6).alias("decay"))
