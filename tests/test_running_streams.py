"""Streams that change, stop, lose their checkpoint or meet events that break them."""

import json
import os
import tempfile
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from socialspark.sources.scratch import exists
from socialspark.streaming import annotations, intake, resume

ROW = "id string, pubkey string, kind int, ingest_ts timestamp"
NOON = datetime(2024, 3, 1, 12)


def folder():
    return "file://" + tempfile.mkdtemp(prefix="stream-test-")


def rows(spark, events):
    return spark.createDataFrame([(f"{i:04d}", a, k, at) for i, a, k, at in events], ROW).coalesce(1)


def batches(spark, base, *parts):
    for events in parts:
        rows(spark, events).write.mode("append").json(f"{base}/in")


def source(spark, base):
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(f"{base}/in")


def minutes(n):
    return NOON + timedelta(minutes=n)


def ended(query, seconds=120):
    assert query.awaitTermination(seconds)


def counted(spark, base, cap=2, **sizes):
    ended(intake.start_counting(spark, base, ROW, cap, once=True, **{"buckets": 4, **sizes}))


def kept(spark, base):
    return sorted(int(r.id) for r in intake.read_intake(spark, base, ROW).collect())


def test_the_cap_follows_an_exempt_table_that_changes_while_the_stream_runs(spark):
    base, table = folder(), folder()
    intake.publish(spark.createDataFrame([("ann",)], "pubkey string"), table, 1)
    now = [0.0]
    exemption = intake.RefreshedExemption(lambda: intake.newest_version(spark, table), 900, lambda: now[0])
    batches(spark, base, [(n, a, 1, minutes(n)) for n, a in enumerate(["ann", "ann", "ann", "bob", "bob", "bob"])])
    split = intake.start_split(source(spark, base), base, exemption, seconds=0)
    try:
        split.processAllAvailable()
        intake.publish(spark.createDataFrame([("bob",)], "pubkey string"), table, 2)
        batches(spark, base, [(10, "bob", 1, minutes(10))])  # a minute later: still the first version
        now[0] = 60
        split.processAllAvailable()
        now[0] = 901
        batches(spark, base, [(n, a, 1, minutes(n)) for n, a in [(20, "bob"), (21, "ann"), (22, "ann"), (23, "ann"), (24, "ann")]])
        split.processAllAvailable()
        assert split.isActive and split.exception() is None
        os.rename(table[7:], table[7:] + "-gone")  # loads fail from here on: the last good copy stays
        now[0] = 2000
        batches(spark, base, [(30, "bob", 1, minutes(30)), (31, "ann", 1, minutes(31)), (32, "cat", 7, minutes(32))])
        split.processAllAvailable()
        assert exemption.error is not None
    finally:
        split.stop()
    counted(spark, base)
    # ann: three while exempt, then two counted ones; bob: two of four counted ones, then free
    assert kept(spark, base) == [0, 1, 2, 3, 4, 20, 21, 22, 30, 32]


def test_everyone_is_exempt_while_no_load_has_succeeded(spark):
    base = folder()
    exemption = intake.RefreshedExemption(lambda: intake.newest_version(spark, folder() + "/none"))
    batches(spark, base, [(n, "ann", 1, minutes(n)) for n in range(6)])
    ended(intake.start_split(source(spark, base), base, exemption, once=True))
    counted(spark, base)
    assert kept(spark, base) == list(range(6)) and isinstance(exemption.error, Exception)


def nobody(spark):
    return intake.RefreshedExemption(lambda: spark.createDataFrame([], "pubkey string"))


def run(spark, base, **sizes):
    ended(intake.start_split(source(spark, base), base, nobody(spark), once=True))
    counted(spark, base, **sizes)


def test_counts_survive_a_restart_and_a_repeated_batch(spark):
    base = folder()
    batches(spark, base, [(0, "ann", 1, minutes(0)), (1, "bob", 6, minutes(1))])
    run(spark, base)
    batches(spark, base, [(2, "ann", 16, minutes(2)), (3, "ann", 1111, minutes(3)), (4, "ann", 7, minutes(4))], [(5, "ann", 1, minutes(5)), (6, "bob", 1, minutes(6)), (7, "bob", 1, minutes(7))])
    write = intake.by_exemption(base, nobody(spark))
    write(rows(spark, [(99, "eve", 1, minutes(0))]), 0)  # batch 0 was written to its end: nothing changes
    run(spark, base)
    assert kept(spark, base) == [0, 1, 2, 4, 6]
    assert not exists(spark, f"{base}/split/batch=3")


def counters(spark, base):
    """Author counters in the store, by day."""
    state = spark.read.format("statestore").option("path", f"{base}/state-counts").option("stateVarName", "used").load()
    return Counter(str(r[0]) for r in state.select("key._day").collect())


def test_a_days_counters_leave_the_state(spark):
    base = folder()
    batches(spark, base, [(n, f"a{n}", 1, minutes(n)) for n in range(5)])
    run(spark, base)
    assert counters(spark, base) == {"2024-03-01": 5}
    day = 24 * 60
    batches(spark, base, [(10, "a0", 1, minutes(day))], [(11, "a0", 1, minutes(day + 200))], [(12, "a0", 1, minutes(day + 201))])
    run(spark, base)
    assert counters(spark, base) == {"2024-03-02": 1}
    assert kept(spark, base) == [0, 1, 2, 3, 4, 10, 11]


def test_authors_beyond_the_bound_are_not_capped(spark):
    base = folder()
    batches(spark, base, [(n, "ann", 1, minutes(n)) for n in range(4)], [(10 + n, "bob", 1, minutes(10 + n)) for n in range(4)], [(20, "ann", 1, minutes(20)), (21, "bob", 1, minutes(21))])
    run(spark, base, buckets=1, bound=1)
    assert kept(spark, base) == [0, 1, 10, 11, 12, 13, 21]
    assert sum(counters(spark, base).values()) == 1


def test_one_author_with_most_rows_is_held_in_small_parts(spark):
    base = folder()
    batches(spark, base, [(n, "ann" if n % 3 else f"b{n}", 1, NOON + timedelta(seconds=3000 - n)) for n in range(3000)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        run(spark, base)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [n for n in kept(spark, base) if n % 3] == [2998, 2999]  # the first two in time of arrival


# -- resume from marks ----------------------------------------------------------------------------


def frames(spark, events):
    """(number, relay, minute of arrival, minutes ahead) as frame lines."""
    out = []
    for n, relay, at, ahead in events:
        body = {"id": f"{n:064d}", "pubkey": "a" * 64, "created_at": int((minutes(at + ahead) - datetime(1970, 1, 1)).total_seconds()), "kind": 1, "tags": [], "content": "x", "sig": "0" * 128}
        out.append((relay, minutes(at), json.dumps(["EVENT", "s", body])))
    return spark.createDataFrame(out, "relay string, ingest_ts timestamp, value string").coalesce(1)


def sightings(spark, base):
    return sorted((int(r.id), r.relay) for r in resume.stored_sightings(spark, base).collect())


def test_a_lost_checkpoint_costs_nothing_and_repeats_little(spark):
    day = 24 * 60
    first = [(n, r, at, 0) for n, (r, at) in enumerate([("a", 0), ("a", 1), ("b", 1), ("a", day), ("b", day + 2), ("a", day + 3), ("a", day + 9)])]
    first += [(0, "b", 3, 0), (50, "a", day + 9, 60)]  # a repeat from another relay; an event an hour ahead, which moves no mark
    second = [(20, "a", day + 10, 0), (21, "b", day + 10, 0), (22, "c", day + 11, 0), (50, "b", day + 12, 58), (6, "b", day + 13, -4), (23, "a", day + 14, 0)]
    landing, base, whole = folder() + "/in", folder(), folder()
    resume.land(frames(spark, first), landing)
    ended(resume.start(spark, landing, base, f"{folder()}/one"))
    marks = {r.relay: (r.mark, r.resume_at) for r in resume.stored_marks(spark, base).collect()}
    assert marks == {"a": (minutes(day + 9), minutes(day + 4)), "b": (minutes(day + 2), minutes(day - 3))}
    resume.land(frames(spark, second), landing)
    again = resume.start(spark, landing, base, f"{folder()}/two")  # the first checkpoint is lost
    ended(again)
    read = sum(p.numInputRows for p in again.recentProgress)
    assert read == len(first + second) - 4  # the first day is not read again
    ended(resume.start(spark, landing, whole, f"{folder()}/three"))
    assert sightings(spark, base) == sightings(spark, whole) == sorted((n, r) for n, r, _, _ in first + second)
    assert len({i for i, _ in sightings(spark, base)}) == 12


def test_a_run_goes_on_under_its_own_checkpoint(spark):
    landing, base, checkpoint = folder() + "/in", folder(), f"{folder()}/c"
    resume.land(frames(spark, [(1, "a", 0, 0)]), landing)
    ended(resume.start(spark, landing, base, checkpoint))
    resume.land(frames(spark, [(2, "a", 1, 0)]), landing)
    ended(resume.start(spark, landing, base, checkpoint))
    assert sightings(spark, base) == [(1, "a"), (2, "a")]
    assert {r.run for r in resume.stored_sightings(spark, base).select("run").collect()} == {0}


# -- annotations ----------------------------------------------------------------------------------


def lengths(calls):
    def process(events):
        with open(calls, "a") as f:
            f.write(f"{len(events)}\n")
        if (events["pubkey"] == "poison").any():
            raise RuntimeError("cannot read this")
        some = events[events["kind"] != 7]
        return pd.DataFrame({"event_id": some["id"], "metric": "n", "value": some["id"].str.len().astype(float)})

    return process


def test_one_poisoned_event_costs_one_event(spark):
    base, calls = folder(), tempfile.mktemp(prefix="calls-")
    events = rows(spark, [(n, "poison" if n == 613 else "ann", 7 if n % 100 == 5 else 1, minutes(0)) for n in range(1000)])
    annotations.annotate_each(base, lengths(calls))(events, 0)
    annotations.annotate_each(base, lengths(calls))(events, 0)  # the batch again: replaced
    out = annotations.read_outcomes(spark, base)
    assert {r.outcome: r.n for r in out.groupBy("outcome").agg(F.count("*").alias("n")).collect()} == {"metric": 989, "skipped": 10, "failed": 1}
    bad = out.where("outcome = 'failed'").first()
    assert bad.event_id == "0613" and bad.error == "RuntimeError: cannot read this"
    sizes = [int(x) for x in open(calls).read().split()]
    assert max(sizes) <= 256 and len(sizes) <= 2 * (4 + 2 * 9)  # halving, not event by event


def test_rows_for_strangers_and_wrong_columns_are_failures(spark):
    events = rows(spark, [(n, "ann", 1, minutes(0)) for n in range(3)])
    stranger = lambda e: pd.DataFrame({"event_id": "zz", "metric": "n", "value": [1.0]})
    got = annotations.outcomes(events, stranger).collect()
    assert sorted((r.event_id, r.outcome) for r in got) == [(f"000{n}", "failed") for n in range(3)]
    assert {r.outcome for r in annotations.outcomes(events, lambda e: pd.DataFrame({"x": [1]})).collect()} == {"failed"}
    assert annotations.outcomes(rows(spark, []), stranger).count() == 0


def test_a_failed_write_gives_no_progress(spark):
    base, calls = folder(), tempfile.mktemp(prefix="calls-")
    batches(spark, base, [(n, "ann", 1, minutes(0)) for n in range(5)])
    write = annotations.annotate_each(f"{base}/out", lengths(calls))

    def broken(batch, batch_id):
        write(batch.withColumn("id", F.raise_error(F.lit("disk full"))), batch_id)

    def start(f):
        return source(spark, base).writeStream.option("checkpointLocation", f"{base}/c").trigger(availableNow=True).foreachBatch(f).start()

    with pytest.raises(Exception, match="disk full"):
        start(broken).awaitTermination(120)
    ended(start(write))
    assert annotations.read_outcomes(spark, f"{base}/out").where("outcome = 'metric'").count() == 5
