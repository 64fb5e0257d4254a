"""Threads that are wider and deeper than the given ones."""

from collections import defaultdict
from datetime import datetime, timedelta

import duckdb

from socialspark.operators import graph
from socialspark.plans import social

START = datetime(2024, 1, 1)
TAG = "event_id string, kind int, created_at timestamp_ntz, tag_key string, tag_value string"


def by_hand(roots, replies):
    children, out = defaultdict(set), set()
    for child, parent in replies:
        children[parent].add(child)
    for root in roots:
        front, seen, level = {root}, {root}, 0
        while front:
            level += 1
            front = {c for p in front for c in children[p]} - seen
            seen |= front
            out |= {(root, c, level) for c in front}
    return out


def expanded(spark, roots, replies, **bounds):
    tags = spark.createDataFrame([(c, 1111 if i % 2 else 1, START + timedelta(seconds=i), "e", p) for i, (c, p) in enumerate(replies)], TAG)
    return {tuple(r) for r in graph.expand_threads(spark.createDataFrame([(r,) for r in roots], "id string"), tags, **bounds).collect()}


def test_a_thread_keeps_all_events_of_a_level(spark):
    replies = [(f"r{i:04d}", "n") for i in range(730)] + [(f"s{i}", f"r{i:04d}") for i in range(0, 730, 7)] + [("t", "m")]
    assert expanded(spark, ["n", "m"], replies) == by_hand(["n", "m"], replies)  # 835 rows: 730 of one level


def test_a_thread_goes_on_to_its_last_level_and_ends_on_cycles(spark):
    replies = [(f"c{i}", f"c{i - 1}") for i in range(1, 15)] + [("x", "c3"), ("x", "c9"), ("c12", "n"), ("c0", "n"), ("c2", "c14"), ("n", "c4"), ("n", "n"), ("y", "z"), ("z", "y")]
    want = by_hand(["n", "c0"], replies)
    assert expanded(spark, ["n", "c0"], replies, levels=None) == want and max(level for _, _, level in want) > 8
    assert expanded(spark, ["n", "c0"], replies) == {r for r in want if r[2] <= 8}


def test_the_sql_of_the_thread_order_takes_any_level():
    ev = [(f"n{i}", 1, [["e", f"n{i - 1}"]] if i else []) for i in range(13)]
    con = duckdb.connect()
    con.execute("CREATE TABLE ev (id VARCHAR, kind INT, tags VARCHAR[][])")
    con.executemany("INSERT INTO ev VALUES (?, ?, ?)", ev)
    con.execute("CREATE TABLE tg AS SELECT id AS event_id, kind, 'e' AS tag_key, tags[1][2] AS tag_value FROM ev WHERE len(tags) > 0")
    assert con.execute(f"SELECT max(level) FROM ({social._EXPAND_ALL})").fetchone() == (12,)
    assert con.execute(f"SELECT max(level) FROM ({social._EXPAND})").fetchone() == (8,)
