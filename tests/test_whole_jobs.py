"""Whole jobs: no rows lost to a filter on ids, a depth or a count."""

from collections import defaultdict
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from socialspark.operators import graph, people, ranking
from socialspark.plans import social
from socialspark.plans.fixtures import Tables

START = datetime(2024, 1, 1)


def test_threads_of_every_root_to_eight_levels(spark):
    notes = [(i, f"n{i}", "u", 1, START, []) for i in range(1, 6)]  # five roots of five residues
    replies = [(100 * i + k, f"r{i}.{k}", "u", 1111 if k % 2 else 1, START + timedelta(seconds=k), [["e", f"r{i}.{k - 1}" if k > 1 else f"n{i}"]]) for i in range(1, 6) for k in range(1, 11)]
    ev = spark.createDataFrame(notes + replies, "event_id long, id string, pubkey string, kind int, created_at timestamp_ntz, tags array<array<string>>")
    tags = ev.where("size(tags) > 0").select(F.col("id").alias("event_id"), "kind", "pubkey", "created_at", F.lit("e").alias("tag_key"), F.col("tags")[0][1].alias("tag_value"))
    children = defaultdict(list)
    for _, c, _, _, _, t in replies:
        children[t[0][1]].append(c)
    want = set()
    for _, root, *_ in notes:
        front, seen = [root], {root}
        for level in range(1, 9):
            front = [c for p in front for c in children[p] if c not in seen]
            seen.update(front)
            want |= {(root, c, level) for c in front}
    assert {tuple(r) for r in social._threads(SimpleNamespace(events=ev, tags=tags)).collect()} == want and len(want) == 40


def test_all_replies_of_a_hot_parent_are_ranked(spark):
    rows = [("hot", f"c{i:05d}", START + timedelta(seconds=i * 7 % 1000)) for i in range(5003)] + [("cold", "d1", START), ("cold", "d2", START)]
    edges = spark.createDataFrame(rows, "parent_id string, child_id string, created_at timestamp_ntz")
    likes = {c: i % 5 for i, (_, c, _) in enumerate(rows) if i % 5}
    counter = spark.createDataFrame(list(likes.items()), "target_event_id string, likes long")
    want = set()
    for parent in ("hot", "cold"):
        own = sorted(((likes.get(c, 0), at, c) for p, c, at in rows if p == parent), reverse=True)
        want |= {(parent, c, n, i) for i, (n, _, c) in enumerate(own, 1)}
    assert {tuple(r) for r in graph.ranked_replies(edges, counter, "likes").collect()} == want


def test_tree_of_a_long_chain_and_a_cycle(spark):
    chain = [(f"n{i}", f"n{i - 1}") for i in range(1, 21)]
    edges = spark.createDataFrame([*chain, ("x", "y"), ("y", "z"), ("z", "x")], "child_id string, parent_id string")
    likes = spark.createDataFrame([("n3", 2)], "target_event_id string, likes long")
    got = {r.node: tuple(r)[1:] for r in graph.thread_tree(edges, likes).collect()}
    want = {f"n{i}": (i, int(i < 20), 20 - i, 2 * (i == 3)) for i in range(21)}
    assert got == want | {c: (2, 1, 2, 0) for c in "xyz"}


def test_search_answers_every_query(spark):
    names = [f"name{i:04d}" for i in range(1203)]
    columns = "pubkey string, name string, display_name string, nip05 string, lud16 string, website string, about string, raw_json string, created_at timestamp_ntz"
    profiles = spark.createDataFrame([(f"p{n}", n, "", "", "", "", "", "", START) for n in names], columns)
    got = people.search_profiles(spark.createDataFrame([(n,) for n in names], "query string"), profiles).collect()
    assert sorted((r.query, r.pubkey, r.position) for r in got) == [(n, f"p{n}", 1) for n in names]


def test_search_equals_a_scan_of_all_pairs(spark):
    key = "ab" * 32
    columns = "pubkey string, name string, display_name string, nip05 string, lud16 string, website string, about string, raw_json string, created_at timestamp_ntz"
    people_rows = [("p1", "Ada Lovelace", None, "", "", "", "an about", "", START), ("p2", "\u65e5\u672c", "ADA", None, "", "", "", "{}", START), (key, "x", "", "", "", "", "", "", START), ("p3", None, None, None, None, None, None, None, START), ("p4", "\u00e9a \u65e5", "", "", "", "", "has " + key, "", START), (None, "lace", "", "", "", "", "", "", START)]
    queries = ["ada", "LACE", "\u65e5", "\u00e9a", "ab", "an about", key, "zzz", None, " ada "]
    got = {(r.query, r.pubkey) for r in people.search_profiles(spark.createDataFrame([(x,) for x in queries], "query string"), spark.createDataFrame(people_rows, columns)).collect()}
    want = {(q.strip(), p[0]) for q in queries if q and len(q.strip().encode()) >= 3 for p in people_rows if q.strip().lower() in " ".join(f for f in p[1:8] if f is not None).lower() or p[0] == q}
    assert got == want


def test_viewers_take_their_boosts_and_the_shared_first_rows(spark):
    pool = [(f"n{i}", START, f"a{i % 4}", float(i // 2)) for i in range(12)]
    follows = [("v1", "a0"), ("v1", "a0"), ("v2", "a3"), ("v2", "nobody"), ("v3", "nobody"), (None, "a1")]
    got = {tuple(r) for r in ranking.per_viewer(spark.createDataFrame(pool, "id string, created_at timestamp_ntz, pubkey string, score double"), spark.createDataFrame(follows, "follower string, followed string"), 3.0, 5).collect()}
    want = set()
    for v in {f for f, _ in follows}:
        mine = {a for f, a in follows if f == v}
        order = sorted(((s + 3.0 * (a in mine), at, i) for i, at, a, s in pool), reverse=True)
        want |= {(v, i, k) for k, (_, _, i) in enumerate(order[:5], 1)}
    assert got == want


def test_files_added_to_a_folder_are_seen(spark, tmp_path):
    import shutil

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf", copy_function=shutil.copyfile)
    (tmp_path / "sf").chmod(0o755)
    sf = f"file://{tmp_path}/sf"
    before = Tables(spark, sf).events.count()
    assert Tables(spark, sf).events.count() == before == spark.read.parquet(f"{sf}/events.parquet").count()
    spark.read.parquet(f"{sf}/events.parquet").where("event_id < 100").coalesce(1).write.parquet(f"{sf}/fewer")
    part = next(p for p in (tmp_path / "sf" / "fewer").iterdir() if p.name.startswith("part-"))
    shutil.copyfile(part, tmp_path / "sf" / "events.parquet")
    assert Tables(spark, sf).events.count() == 100
