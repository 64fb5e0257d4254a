"""Small cases of the social-event operators, and a selection of queries against their SQL twins."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from socialspark import registry
from socialspark.functions import tags as tg
from socialspark.functions import text as tx
from socialspark.operators import enrich, jobs, ranking
from socialspark.operators.aggregate import AggregateSpec, aggregate
from socialspark.operators.query import EventQuery
from socialspark.sources.ingest import decode_frames, flatten_tags, note_zaps, split_by_shape

SF = "/root/testdata/sf0.001"
EVENT = "id string, pubkey string, kind int, created_at timestamp_ntz, tags array<array<string>>, content string"
H = lambda c: c * 64


def events(spark, rows):
    return spark.createDataFrame([(i, p, k, datetime(2024, 1, 1, 0, 0, s), t, c) for i, p, k, s, t, c in rows], EVENT)


def test_invoice_amounts(spark):
    cases = [("lnbc31abc", 300_000_000), ("lnbc70u1zz", 7_000), ("LNBC4M1q", 400_000), ("lnbc90n1xy", 9), ("lnbc50000p1k", 5), ("lntb1", 0), ("", 0), (None, 0)]
    df = spark.createDataFrame(cases, "v string, n long")
    assert df.select(tx.bolt11_sats(F.col("v")).alias("s"), "n").where("s <> n").count() == 0


def test_zap_takes_amount_and_own_target(spark):
    tags = [["e", H("a")], ["amount", "457000"], ["bolt11", "lnbc2500u1x"], ["description", '{"tags":[["e","' + H("b") + '"]]}']]
    row = note_zaps(events(spark, [(H("c"), H("d"), 9735, 1, tags, "")])).first()
    assert (row.target_event_id, row.sats) == (H("a"), 457)


def test_policies():
    assert [tx.policy_thresholds(p) for p in ("RELAXED", "moderate", "", "odd")] == [(0, 0), (20, 60), (50, 80), (50, 80)]


def test_reply_edges_prefer_markers_and_skip_quoted_parents(spark):
    rows = [
        (H("1"), H("u"), 1, 1, [["e", H("a"), "", "root"], ["e", H("b"), "", "reply"]], ""), (H("2"), H("u"), 1, 2, [["e", H("a")], ["e", H("b")]], ""),
        (H("3"), H("u"), 1, 3, [["e", H("a"), "", "root"]], ""), (H("4"), H("u"), 1, 4, [["e", H("a"), "", "reply"], ["q", H("a")]], ""),
    ]
    got = {r.child_id[0]: r.parent_id[0] for r in jobs.reply_edges(flatten_tags(events(spark, rows))).collect()}
    assert got == {"1": "b", "2": "b", "3": "a"}


def test_reasons(spark):
    rows = [(H("1"), "u", 3, 1, [], "", "follow"), (H("2"), "u", 1, 1, [["e", "x", "", "reply"]], "", "reply"), (H("3"), "u", 1, 1, [["q", "x"]], "", "quote"), (H("4"), "u", 1, 1, [["p", "x"]], "", "mention"), (H("5"), "u", 42, 1, [], "", "else")]
    df = events(spark, [r[:6] for r in rows])
    got = {r.id: r.r for r in df.select("id", tg.notification_reason(F.col("kind"), F.col("tags"), F.lit("else")).alias("r")).collect()}
    assert got == {r[0]: r[6] for r in rows}


def test_frames_and_shapes(spark):
    good = '["EVENT","s",{"id":"' + H("a") + '","pubkey":"' + H("b") + '","created_at":5,"kind":1,"tags":[["e","x"]],"content":"hi","sig":"' + "0" * 128 + '"}]'
    short = good.replace(H("b"), "b")
    df = spark.createDataFrame([(good,), (short,), ('["EOSE","s"]',), ("not json",), (None,)], "value string")
    valid, rejected = split_by_shape(decode_frames(df))
    assert valid.count() == 1
    assert [r.reason for r in rejected.collect()] == ["pubkey"]


def test_quality_of_a_reasoned_reply(spark):
    rows = [(H("1"), "u", 1, 1, [["e", "x"]], "The numbers do not add up, since every source and each example in the appendix points elsewhere."), (H("2"), "u", 1, 1, [], "a note of its own")]
    got = enrich.quality_columns(events(spark, rows)).collect()
    assert [r.id for r in got] == [H("1")] and got[0].contribution_quality > 0.5


def test_bad_requests_are_refused(spark):
    with pytest.raises(ValueError):
        EventQuery().checked()
    with pytest.raises(ValueError):
        EventQuery(kinds=(1,), limit=501).checked()
    with pytest.raises(ValueError):
        aggregate(events(spark, []), AggregateSpec("EVENTS", ("TAG_KEY",), ("COUNT",)))


def test_routing():
    t = (ranking.Term("references", "likes", 1.0),)
    assert ranking.route(t, True) == "features" and ranking.route(t, False) == "live"


def test_sketches_merge(spark):
    rows = [(H(c), c, 7, 1, [["e", H("a")]], "+") for c in "bcdef"]
    t = flatten_tags(events(spark, rows))
    merged = jobs.merged_counts([jobs.like_counts(t.where("pubkey <= 'd'"), sketch=True), jobs.like_counts(t, sketch=True)], "likes").first()
    assert merged.likes == 5


def test_jobs_do_not_depend_on_order(spark):
    rows = [(H(c), c, 1, n, [["e", H("a")]], "") for n, c in enumerate("bcdef")]
    one, two = (jobs.reply_edges(flatten_tags(events(spark, r))).collect() for r in (rows, rows[::-1]))
    assert sorted(one) == sorted(two)


@pytest.mark.parametrize("name", ["m1_note_like_counts", "m5_note_reply_edges", "m8_note_engagement_real", "q1_note_stats", "a1_events_by_kind_author", "r1_feature_ranking", "e1_contribution_quality", "q27_leaderboard"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert key(cur.fetchall()) == key(tuple(r) for r in df.select(*names).collect())


def test_every_query_has_a_name_and_most_have_sql():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.oracle_sql()) >= 0.9 * len(registry.queries())
