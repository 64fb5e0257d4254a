"""Rules of intake, retention, exclusion, roll-ups and the feed walker on rows made for them."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from socialspark.operators import graph, jobs, notify, retention
from socialspark.operators.query import EventQuery, select_events
from socialspark.plans.fixtures import Tables
from socialspark.sources import scratch
from socialspark.sources.ingest import split_by_shape
from socialspark.streaming.ingest import ExemptAuthors

SF = "/root/testdata/sf0.001"
H = lambda c: c * 64
SHAPE = "id string, pubkey string, sig string, tags array<array<string>>, content string"


def test_missing_fields_are_rejected(spark):
    rows = [(H("1"), H("a"), "s" * 128, [], ""), (H("2"), None, "s" * 128, [], ""), (H("3"), H("a"), None, [], ""), (None, H("a"), "s" * 128, [], ""), (H("5"), H("a"), "s" * 128, None, None)]
    good, bad = split_by_shape(spark.createDataFrame(rows, SHAPE))
    assert {r.id for r in good.collect()} == {H("1"), H("5")}  # absent tags and content have length 0
    assert {(r.id, r.reason) for r in bad.collect()} == {(H("2"), "pubkey"), (H("3"), "sig"), (None, "id")}


def test_report_names_a_rule_that_leaves_nothing(spark):
    before = spark.range(7)
    got = {r.rule: (r.matched, r.acts) for r in retention.report(before, {"all": before.where("false"), "none": before}, 5).collect()}
    assert got == {"all": (7, True), "none": (0, False)}


def test_exclusions_keep_null_authors_at_any_length(spark):
    events = spark.createDataFrame([("1", "a", 1), ("2", None, 1), ("3", "b", 1)], "id string, pubkey string, kind int")
    for many in (("a",), ("a", *map(str, range(20_000)))):
        q = EventQuery(kinds=(1,), exclude_pubkeys=many)
        assert {r.id for r in select_events(events, q).collect()} == {"2", "3"}


def test_engagement_equals_brute_force(spark):
    t = Tables(spark, SF)
    targets = jobs.engaged_targets(t.tags, t.zaps, t.as_of - F.expr("INTERVAL 1000 DAYS"))
    got = {r.event_id: (r.real_likes, r.real_reposts, r.real_replies, r.real_quotes, r.real_zaps, r.real_zap_sats, r.real_actors) for r in jobs.engagement_real(targets, t.tags, t.zaps, t.edges, t.events, t.scores).collect()}
    known = {r.pubkey for r in jobs.scored_actors(t.scores, 50.0).collect()}
    author = {r.id: r.pubkey for r in t.events.select("id", "pubkey").collect()}
    acts = defaultdict(set)
    sats = defaultdict(int)
    for r in t.tags.where("octet_length(tag_value) = 64").collect():
        if r.tag_key == "e" and r.kind in (6, 7, 16):
            acts[r.tag_value].add(("likes" if r.kind == 7 else "reposts", r.pubkey))
        if r.tag_key == "q" and r.kind == 1:
            acts[r.tag_value].add(("quotes", r.pubkey))
    for r in t.edges.collect():
        acts[r.parent_id].add(("replies", r.child_pubkey))
    for r in t.zaps.collect():
        acts[r.target_event_id].add(("zaps", r.pubkey))
        sats[r.target_event_id] += r.sats if r.pubkey in known else 0
    assert len(got) > 50
    for event, row in got.items():
        own = {(w, a) for w, a in acts[event] if a in known}
        others = {(w, a) for w, a in own if a != author[event]}
        count = lambda rows, what: sum(w == what for w, _ in rows)
        assert row == (*(count(others, w) for w in ("likes", "reposts", "replies", "quotes")), count(own, "zaps"), sats[event], len({a for _, a in others}))


def test_a_failed_stage_ends_the_tick(spark, tmp_path):
    ran = []

    def stage(name, fails=False):
        def run(done):
            ran.append((name, sorted(done)))
            return spark.range(3).select(F.raise_error(F.lit("no")).alias("id")) if fails else spark.range(3)

        return run

    with pytest.raises(Exception, match="no"):
        jobs.run_stages(spark, {"a": stage("a"), "b": stage("b", True), "c": stage("c")}, str(tmp_path / "t"))
    assert ran == [("a", []), ("b", ["a"])]
    done = jobs.run_stages(spark, {"a": stage("a"), "c": stage("c")}, str(tmp_path / "t"))  # the next tick starts over
    assert {k: v.count() for k, v in done.items()} == {"a": 3, "c": 3}


def test_feed_slices_cover_history_once():
    now, c, seen = datetime(2024, 3, 1), notify.FeedCursors(), []
    for tick in range(400):
        windows, c = notify.feed_slices(c, now + timedelta(minutes=5 * tick))
        seen += windows
        if tick:
            assert windows[0][0] == c.head - timedelta(minutes=15)  # five minutes on, ten again
    assert c.edge <= c.head - timedelta(days=14) + timedelta(minutes=5 * 400)
    at = min(s for s, _ in seen)
    for start, end in sorted(seen):
        assert start <= at
        at = max(at, end)
    assert at == c.head


def test_exempt_authors_keep_the_last_good_copy(spark):
    loads = iter([["a", "b"], None, ["c"]])

    def load():
        names = next(loads)
        if names is None:
            raise OSError("gone")
        return spark.createDataFrame([(n,) for n in names], "pubkey string")

    e = ExemptAuthors(load)
    assert e.refresh() and {r.pubkey for r in e.copy.collect()} == {"a", "b"}
    assert not e.refresh() and isinstance(e.error, OSError) and {r.pubkey for r in e.copy.collect()} == {"a", "b"}
    assert e.refresh() and e.error is None and {r.pubkey for r in e.copy.collect()} == {"c"}
    with pytest.raises(StopIteration):
        ExemptAuthors(lambda: next(iter([]))).refresh()


def test_chain_with_allowed_authors_and_fan_out(spark):
    roots = spark.createDataFrame([("r", "me")], "id string, pubkey string")
    at = lambda n: datetime(2024, 1, n)
    edges = spark.createDataFrame([("r", "x1", "ann", 1, at(1)), ("r", "x2", "bob", 1, at(2)), ("x2", "x3", "ann", 1111, at(3)), ("x2", "x4", "eve", 1, at(2)), ("r", "x5", "bob", 1, at(4))],
                                  "parent_id string, child_id string, child_pubkey string, kind int, created_at timestamp_ntz")
    allowed = spark.createDataFrame([("bob",), ("ann",)], "author string")
    chain = lambda **kw: sorted((r.event_id, r.step) for r in graph.authored_chain(roots, edges, **kw).collect())
    assert chain() == []
    assert chain(allowed=allowed) == [("x1", 1)]
    assert chain(allowed=allowed, fan_out=2) == [("x1", 1), ("x2", 1), ("x3", 2)]
    assert chain(allowed=allowed, fan_out=2, via=F.col("kind") == 1) == [("x1", 1), ("x2", 1)]
    assert chain(allowed=spark.createDataFrame([("r", "bob")], "root_id string, author string")) == [("x2", 1)]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master, applicationId = "local-cluster[3,2,1000]", "app"

        def getConf(self):  # noqa: N802
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
