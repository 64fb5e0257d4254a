"""The notification feed: what it says of references, and how often it deals rows out."""

from datetime import datetime

from pyspark.sql import functions as F

from socialspark.operators import jobs, notify
from socialspark.sources.ingest import flatten_tags

EVENT = "id string, pubkey string, kind int, created_at timestamp_ntz, tags array<array<string>>, content string"
KEY = {n: f"{i:064x}" for i, n in enumerate(("ann", "bob", "cat", "root", "gone", "reply", "answer"))}


def feed(spark):
    at = datetime(2024, 1, 2)
    e = lambda key, marker: ["e", KEY[key], "", marker]
    p = lambda key: ["p", KEY[key]]
    events = spark.createDataFrame([
        (KEY["root"], KEY["ann"], 1, datetime(2023, 12, 1), [], ""),  # before the window: still an author
        (KEY["reply"], KEY["bob"], 1, at, [e("root", "root"), e("gone", "reply"), p("ann"), p("cat")], ""),
        (KEY["answer"], KEY["cat"], 1, at, [e("reply", ""), p("bob")], ""),
    ], EVENT)
    tags, scores = flatten_tags(events), spark.createDataFrame([("reputation", KEY["bob"], 7.0, at)], "source string, pubkey string, score double, fetched_at timestamp_ntz")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return notify.feed(jobs.notification_candidates(tags), events, tags, scores, day("2024-01-01"), day("2024-01-03"))


def test_parents_and_threads(spark):
    got = {(r.viewer, r.event_id): (r.is_reply, r.direct_parent_author, r.replies_viewer_thread, r.actor_score) for r in feed(spark).collect()}
    # the parent by its marker is unknown, so it has no author; the root's author is not taken for it
    assert got == {
        (KEY["ann"], KEY["reply"]): (True, "", True, 7.0), (KEY["cat"], KEY["reply"]): (True, "", False, 7.0),
        (KEY["bob"], KEY["answer"]): (True, KEY["bob"], True, 0.0),
    }


def test_rows_are_dealt_out_by_event_once(spark):
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        plan = feed(spark)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert plan.count("Exchange ") <= 9  # 18 when candidates, parents and threads were each joined by keys of their own
