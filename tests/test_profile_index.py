"""Search by posting lists equals a scan of all pairs of queries and profiles."""

import random
from datetime import datetime, timedelta

from socialspark.operators import people

FIELDS = ["name", "display_name", "nip05", "lud16", "website", "about", "raw_json"]
SCHEMA = "pubkey string, created_at timestamp_ntz, " + ", ".join(f"{f} string" for f in FIELDS)


def brute(queries, rows, limit):
    out = []
    for q in {x.strip() for x in queries}:
        if len(q.encode()) < 3:
            continue
        low, hits = q.lower(), []
        for r in rows:
            p = dict(zip(["pubkey", "created_at", *FIELDS], r, strict=True))
            tests = {"is": lambda f: f.lower() == low, "starts": lambda f: f.lower().startswith(low), "has": lambda f: low in f.lower()}  # noqa: B023
            score = max([100 if p["pubkey"] == q else 0, *[s for s, how, f in people.TIERS if tests[how](p[f])]])
            if low in " ".join(p[f] for f in FIELDS).lower() or p["pubkey"] == q:
                hits.append((-score, -(p["created_at"] - datetime(2000, 1, 1)).total_seconds(), p["pubkey"]))
        out += [(q, pk, float(-s), n + 1) for n, (s, _, pk) in enumerate(sorted(hits)[:limit])]
    return sorted(out)


def test_every_query_finds_what_a_scan_finds(spark):
    r = random.Random(6)
    parts = ["ann", "Bob", "日本", "é", "user", "7", "@x.org", "ab", "z"]
    text = lambda: "".join(r.choice(parts) for _ in range(r.randrange(4)))
    rows = [(f"{k:064x}", datetime(2024, 1, 1) + timedelta(days=r.randrange(9)), *[text() for _ in FIELDS]) for k in range(120)]
    profiles = spark.createDataFrame(rows, SCHEMA)
    queries = ["ann", "ANNBob", "日", "日本", "éé", "ab", "  user7 ", "@x.org", "nothing here", "zzz", "bobann7", rows[5][0], "user", "org ann"]
    index = people.gram_postings(profiles)
    made = people.search_profiles(spark.createDataFrame([(q,) for q in queries], "query string"), profiles, 5, index=(index, people.gram_counts(index)))
    assert sorted(map(tuple, made.collect())) == brute(queries, rows, 5)
    blocks = people.search_profiles(spark.createDataFrame([(q,) for q in queries], "query string"), profiles, 5, block=3)
    assert sorted(map(tuple, blocks.collect())) == brute(queries, rows, 5)
    assert people.search_profiles(spark.createDataFrame([("a",)], "query string"), profiles).count() == 0


def test_no_profile_is_exploded_at_query_time(spark, capsys):
    profiles = spark.createDataFrame([("a" * 64, datetime(2024, 1, 1), *["ann"] * 7)], SCHEMA)
    postings = people.cut(people.gram_postings(profiles), "p")
    counts = people.cut(people.gram_counts(postings), "c")
    people.search_profiles(spark.createDataFrame([("ann",)], "query string"), profiles, index=(postings, counts)).explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "BroadcastNestedLoop" not in plan
