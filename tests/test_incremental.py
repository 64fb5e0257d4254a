"""Features kept up to date by ticks equal a full rebuild."""

import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from socialspark.operators import incremental
from socialspark.operators.incremental import RollUp
from socialspark.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"


def folder():
    return "file://" + tempfile.mkdtemp(prefix="rollup-test-")


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(spark, roll, name):
    return {f for f in spark.read.parquet(f"{roll.base}/{name}").inputFiles()}


def test_ticks_equal_a_rebuild_and_touch_little(spark):
    t = Tables(spark, SF)
    log = t.events.drop("event_id", "user_id")
    times = sorted(r.created_at for r in log.select("created_at").collect())
    at = times[int(len(times) * 0.99)]
    whole = RollUp(spark, folder(), 8)
    whole.tick(log, t.scores)
    parts = RollUp(spark, folder(), 32)
    first = parts.tick(log.where(F.col("created_at") <= F.lit(at)), t.scores)
    before = files(spark, parts, "acts")
    second = parts.tick(log, t.scores)
    assert first.events + second.events == len(times) and second.events <= len(times) / 50
    assert second.targets < first.targets / 10 and second.buckets < 32
    assert files(spark, parts, "acts") & before  # buckets that nothing new falls in keep their files
    assert rows(parts.features()) == rows(whole.features()) != []
    assert parts.tick(log, t.scores).events == 0 and rows(parts.features()) == rows(whole.features())


def event(n, author, kind, minute, *tags):
    return (f"{n:064d}", author, kind, datetime(2024, 1, 1) + timedelta(minutes=minute), [list(x) for x in tags], "")


EVENT = "id string, pubkey string, kind int, created_at timestamp_ntz, tags array<array<string>>, content string"


def test_a_repeated_tick_late_targets_and_changed_scores(spark):
    note = f"{1:064d}"
    log = [event(2, "ann", 7, 1, ("e", note)), event(3, "ann", 7, 2, ("e", note)), event(4, "bob", 7, 3, ("e", note)), event(5, "eve", 9735, 4, ("e", note), ("amount", "5000"))]
    scores = lambda good: spark.createDataFrame([("reputation", a, 90.0 if a in good else 1.0, 0.0, 0, 0, datetime(2024, 1, 1)) for a in ("ann", "bob", "eve")],
                                                "source string, pubkey string, score double, rank double, followers long, nodes long, fetched_at timestamp_ntz")
    df = lambda events: spark.createDataFrame(events, EVENT)
    roll = RollUp(spark, folder(), 4)
    roll.tick(df(log), scores(["ann"]))
    assert rows(roll.features()) == []  # the note itself is not there yet
    late = [*log, event(1, "bob", 1, 9)]
    roll.tick(df(late), scores(["ann"]))
    names = ["raw_likes", "raw_zaps", "raw_sats", "real_likes", "real_zaps", "real_zap_sats", "real_actors"]
    assert rows(roll.features().select(*names)) == [(2, 1, 5, 1, 0, 0, 1)]
    crashed = RollUp(spark, roll.base, 4)
    crashed.cursor = lambda: None  # as after a crash before the cursor was stored
    crashed.tick(df(late), scores(["ann"]))
    assert rows(roll.features().select(*names)) == [(2, 1, 5, 1, 0, 0, 1)]
    roll.tick(df(late), scores(["ann", "bob", "eve"]), rescored=spark.createDataFrame([("eve",)], "pubkey string"))
    assert rows(roll.features().select(*names)) == [(2, 1, 5, 1, 1, 5, 2)]


def test_what_is_stored_is_neither_written_nor_shuffled_again(spark):
    t = Tables(spark, SF)
    log = t.events.drop("event_id", "user_id")
    times = sorted(r.created_at for r in log.select("created_at").collect())
    roll, at = RollUp(spark, folder(), 4), times[int(len(times) * 0.9)]
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    began = shuffled()
    roll.tick(log.where(F.col("created_at") <= F.lit(at)), t.scores)
    before, first = {n: files(spark, roll, n) for n in ("acts", "notes", "features")}, shuffled() - began
    began = shuffled()
    roll.tick(log, t.scores)  # a tenth of the events, which name targets in every bucket
    assert shuffled() - began < 0.6 * first
    assert all(before[n] and before[n] <= files(spark, roll, n) for n in before)
    again = RollUp(spark, roll.base, 4)
    spark.sql(f"DROP TABLE {again._table('acts', incremental.ACTS)}")  # as in an application that comes later: the files last
    assert rows(again.features()) == rows(roll.features()) != [] and again.tick(log, t.scores).events == 0
