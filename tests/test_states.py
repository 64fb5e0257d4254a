"""Aggregates kept as states: many batches, repeats, folding."""

import tempfile
from datetime import datetime

from socialspark.streaming import states

EVENT = "id string, pubkey string, kind int, created_at timestamp_ntz, tags array<array<string>>, content string"
AT = datetime(2024, 1, 1)
NOTE = ["a" * 64, "b" * 64]


def batch(spark, k, n=40):
    """Likes from actors that come again in later batches, reposts, a quote and a zap."""
    rows = [(f"{k:030d}{i:034d}", f"{(k * 7 + i) % 900:064d}", 7 if i % 4 else 6, AT, [["e", NOTE[i % 2]]], "+") for i in range(n)]
    rows += [(f"q{k:063d}", "q" * 64, 1, AT, [["q", NOTE[0]]], ""), (f"z{k:063d}", "z" * 64, 9735, AT, [["e", NOTE[1]], ["amount", str(1000 * (k + 1))]], "")]
    return rows


def test_fifty_batches_equal_one_pass_and_open_few_files(spark):
    base = "file://" + tempfile.mkdtemp(prefix="states-test-")
    write, every, opened = states.keep_states(base, 8), [], []
    for k in range(50):
        rows = batch(spark, k)
        every += rows
        df = spark.createDataFrame(rows, EVENT).coalesce(1)
        write(df, k)
        if k in (3, 8, 21):
            write(df, k)  # again: replaced, or held by a base already
        if k % 10 == 9:
            opened.append(len(states._paths(spark, base)[2]))
    got = {r.target_event_id: r for r in states.counts(states.read_states(spark, base)).collect()}
    assert max(opened) <= 8
    for note in NOTE:
        named = [(k, p, i) for i, p, k, _, tags, _ in every for t in tags if t[1] == note]
        exact = {"likes": len({p for k, p, _ in named if k == 7}), "reposts": len({p for k, p, _ in named if k == 6})}
        for name, n in exact.items():
            assert abs(got[note][name] - n) <= max(4 * 0.016 * n, 1), (name, got[note][name], n)
    assert got[NOTE[0]].quotes == 50 and got[NOTE[1]].zaps == 50 and got[NOTE[1]].sats == sum(range(1, 51))
    assert states.read_states(spark, base + "/none").count() == 0


def test_a_batch_is_read_once_and_shuffled_once(spark):
    plan = states.batch_states(spark.createDataFrame(spark.sparkContext.parallelize(batch(spark, 0), 2), EVENT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange") == 1  # a scan of a batch runs its whole stream plan again


def test_a_batch_leaves_few_files(spark):
    base, before = "file://" + tempfile.mkdtemp(prefix="states-test-"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream with state
    try:
        rows = [(f"{i:064d}", "a" * 64, 7, AT, [["e", f"{i:064d}"]], "+") for i in range(400)]
        states.keep_states(base, 8)(spark.createDataFrame(rows, EVENT), 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(spark.read.parquet(f"{base}/batches/batch=0").inputFiles()) <= states.WRITERS
    assert states.read_states(spark, base).count() == 400
