"""The relevant order of a thread, by hand and over the given events."""

from socialspark.operators import graph
from socialspark.plans import social

SF = "/root/testdata/sf0.001"


def test_tiers_in_order(spark):
    threads = spark.createDataFrame([("r", x, i) for i, x in enumerate("abcdefg")] + [("s", "z", 0)], "root_id string, event_id string, place int")
    chain = spark.createDataFrame([("r", "c", 1), ("r", "x", 2)], "root_id string, event_id string, step int")  # x is not of the thread
    followed = spark.createDataFrame([("r", "c"), ("r", "e")], "root_id string, event_id string")
    ranked = spark.createDataFrame([("r", "e", 1, -5), ("r", "g", 2, -1), ("r", "b", 3, -2), ("r", "d", 4, -9)], "root_id string, event_id string, position int, recency long")
    got = graph.thread_order(threads, chain, followed, ranked, ranked_limit=2).collect()
    order = {r: [x.event_id for x in sorted(got, key=lambda x: x.position) if x.root_id == r] for r in "rs"}
    assert order == {"r": ["c", "e", "g", "d", "b", "a", "f"], "s": ["z"]}


def test_thread_order_of_the_given_events(spark):
    places = {}
    for r in social.Q["q15_thread_order"](spark, SF).collect():
        places.setdefault(r.root_id, {})[r.event_id] = r.position
    whole = {}
    for r in social.Q["q14_threads"](spark, SF).collect():
        whole.setdefault(r.root_id, set()).add(r.event_id)
    assert {k: set(v) for k, v in places.items()} == whole
    assert all(sorted(v.values()) == list(range(1, len(v) + 1)) for v in places.values())


def test_every_viewer_gets_the_best_followed_reply_of_each_parent(spark):
    from datetime import datetime

    from socialspark.operators import graph

    a, upper, word = "0a" * 32, "0A" * 32, "viewer"
    at = datetime(2024, 1, 1)
    edges = spark.createDataFrame([("c1", "p", "x", 1, at), ("c2", "p", "y", 1, at), ("c3", "p", "x", 1, at), ("c4", a, "x", 1, at)], "child_id string, parent_id string, child_pubkey string, kind int, created_at timestamp_ntz")
    follows = spark.createDataFrame([(a, "x"), (a, "y"), (upper, "x"), (word, "y")], "follower string, followed string")
    likes = spark.createDataFrame([("c2", 3)], "target_event_id string, likes long")
    got = {(r.viewer, r.parent_id): r.child_id for r in graph.best_followed_reply(None, edges, follows, likes).collect()}
    assert got == {(a, "p"): "c2", (upper, "p"): "c3", (word, "p"): "c2", (a, a): "c4", (upper, a): "c4"}
    some = spark.createDataFrame([(a, "p"), (word, a)], "viewer string, parent_id string")
    assert [tuple(r) for r in graph.best_followed_reply(some, edges, follows, likes).collect()] == [(a, "p", "c2")]


def test_packed_keys_stay_bytes_in_the_shuffles(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(social, "cut", lambda df, label: seen.update({label: dict(df.dtypes)}) or df)
    order = graph.thread_order
    monkeypatch.setattr(graph, "thread_order", lambda *frames: seen.update(frames=[dict(f.dtypes) for f in frames]) or order(*frames))
    rows = social.Q["q15_thread_order"](spark, SF)
    assert all(types[k] == "binary" for types in (seen["threads"], *seen["frames"]) for k in ("root_id", "event_id"))  # 64 digits took twice the room
    assert dict(rows.dtypes) == {"root_id": "string", "event_id": "string", "position": "int"}
