"""Retention on stored tables touches what it must and nothing else."""

import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from socialspark.operators import retention, stored

LOG = "id string, pubkey string, kind int, created_at timestamp_ntz, tags array<array<string>>, month string"
MONTHS = [datetime(2024, 1, 5), datetime(2024, 2, 5), datetime(2024, 3, 5), datetime(2024, 4, 5)]


@pytest.fixture
def log(spark):
    path = tempfile.mkdtemp(prefix="stored-") + "/log"
    rows = [(f"n{m}{k}", "ann", 1, at + timedelta(days=k), []) for m, at in enumerate(MONTHS) for k in range(3)]
    rows += [("p0", "ann", 0, MONTHS[0], []), ("p1", "ann", 0, MONTHS[2], []), ("x", "eve", 4, MONTHS[1], [])]
    df = spark.createDataFrame(rows, LOG.rsplit(",", 1)[0])
    df.withColumn("month", F.date_format("created_at", "yyyy-MM")).write.partitionBy("month").parquet(f"file://{path}")
    return path


def files(path):
    return {d.split("/")[-1]: {f: os.stat(f"{d}/{f}").st_mtime_ns for f in names if f.endswith(".parquet")} for d, _, names in os.walk(path) if "=" in d}


def ids(spark, path):
    return {r.id for r in stored.read_stored(spark, f"file://{path}", LOG).collect()}


def test_only_months_that_lose_rows_are_written_again(spark, log):
    before, all_ids = files(log), ids(spark, log)
    change = stored.apply_rules(spark, f"file://{log}", LOG, {"kinds": lambda e: retention.prune_kinds(e, (0, 1))[0], "latest": retention.keep_latest})
    assert change["kinds"] == stored.Change(("2024-02",), (), 1) and change["latest"] == stored.Change(("2024-01",), (), 1)
    after = files(log)
    assert after["month=2024-03"] == before["month=2024-03"] and after["month=2024-04"] == before["month=2024-04"]
    assert after["month=2024-01"] != before["month=2024-01"]
    assert ids(spark, log) == all_ids - {"x", "p0"}
    again = stored.apply_rules(spark, f"file://{log}", LOG, {"latest": retention.keep_latest})
    assert again["latest"] == stored.Change((), (), 0) and files(log) == after


def test_a_month_without_survivors_is_dropped(spark, log):
    before = files(log)
    doomed = spark.createDataFrame([("n10",), ("n11",), ("n12",), ("x",), ("n20",), ("none",)], "id string")
    change = stored.remove(spark, f"file://{log}", LOG, "month", ["id"], doomed, ["id"])
    assert change == stored.Change(("2024-03",), ("2024-02",), 5)
    after = files(log)
    assert "month=2024-02" not in after and after["month=2024-01"] == before["month=2024-01"]
    assert ids(spark, log) == {"n00", "n01", "n02", "p0", "n21", "n22", "p1", "n30", "n31", "n32"}


def test_a_rule_that_matches_too_little_does_nothing(spark, log):
    before = files(log)
    change = stored.apply_rules(spark, f"file://{log}", LOG, {"kinds": lambda e: retention.prune_kinds(e, (0, 1))[0]}, min_matched=2)
    assert change["kinds"].removed == 0 and files(log) == before


def test_silent_posts_of_a_stored_log(spark, log):
    as_of = F.lit(datetime(2025, 2, 5)).cast("timestamp_ntz")
    liked = spark.createDataFrame([("n00",)], "target_event_id string")
    change = stored.apply_rules(spark, f"file://{log}", LOG, {"silent": lambda e: retention.drop_silent_posts(e, [liked], as_of)})
    assert change["silent"] == stored.Change(("2024-01", "2024-02"), (), 3)  # n01, n02, n10: more than 365 days old and not liked
    assert {"n00", "n11", "p0", "x"} <= ids(spark, log) and not {"n01", "n02", "n10"} & ids(spark, log)


def test_rules_move_no_wide_rows_and_end_in_one_rewrite(spark):
    path = tempfile.mkdtemp(prefix="stored-") + "/log"
    at = F.lit(MONTHS[0]).cast("timestamp_ntz") + F.expr("make_dt_interval(id % 90)")
    wide = F.array(F.array(*[F.sha2(F.concat(F.lit(f"{k}"), "id"), 256) for k in range(20)]))
    df = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.concat(F.lit("u"), F.col("id") % 500).alias("pubkey"), F.element_at(F.array(*map(F.lit, (0, 1, 3, 4))), (F.col("id") % 4 + 1).cast("int")).alias("kind"), at.alias("created_at"), wide.alias("tags"))
    df.withColumn("month", F.date_format("created_at", "yyyy-MM")).write.partitionBy("month").parquet(f"file://{path}")
    before, whole = stored.read_stored(spark, f"file://{path}", LOG).drop("tags").toPandas(), sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    began = shuffled()
    rules = {"kinds": lambda e: retention.prune_kinds(e, (0, 1, 3))[0], "latest": retention.keep_latest, "ids": lambda e: e.where(~F.col("id").startswith("0")).select("id")}
    change = stored.apply_rules(spark, f"file://{path}", LOG, rules)
    assert shuffled() - began < whole / 4  # the whole log moved with each rule
    kept = before[before.kind != 4]
    newest = kept[kept.kind != 1].sort_values(["created_at", "id"]).groupby(["kind", "pubkey"]).tail(1)
    kept = set(kept[kept.kind == 1].id) | set(newest.id)
    assert ids(spark, path) == {i for i in kept if i[0] != "0"}
    assert change["kinds"].removed == 10_000 and change["latest"].removed == 30_000 - len(kept) and sum(c.removed for c in change.values()) == 40_000 - len(ids(spark, path))


FEED = "viewer string, computed_at timestamp_ntz, day string"


@pytest.mark.parametrize("hour, kept, change", [(12, 14, (1, 5)), (0, 15, (0, 5)), (23, 14, (0, 6))])
def test_expiry_drops_days_and_cuts_the_day_of_the_bound(spark, hour, kept, change):
    path = tempfile.mkdtemp(prefix="stored-") + "/feed"
    start = datetime(2024, 1, 1, 6)
    rows = [(f"v{d}", start + timedelta(days=d)) for d in range(20)] + ([("late", datetime(2024, 1, 6, 18))] if hour == 12 else [])
    spark.createDataFrame(rows, "viewer string, computed_at timestamp_ntz").withColumn("day", F.date_format("computed_at", "yyyy-MM-dd")).write.partitionBy("day").parquet(f"file://{path}")
    before = files(path)
    as_of = F.lit(datetime(2024, 1, 20, hour)).cast("timestamp_ntz")
    got = stored.expire(spark, f"file://{path}", FEED, "feed", as_of, "computed_at", ["viewer"])
    assert (len(got.rewritten), len(got.dropped)) == change
    left = [r.viewer for r in stored.read_stored(spark, f"file://{path}", FEED).collect()]
    assert len(left) == kept + (hour == 12) and ("late" in left) == (hour == 12)
    after = files(path)
    assert all(after[d] == before[d] for d in after if d > "day=2024-01-06")
    assert stored.expire(spark, f"file://{path}", FEED, "feed", as_of, "computed_at", ["viewer"]) == stored.Change((), (), 0)


def test_hourly_counts_take_late_data_within_ten_minutes(spark):
    from socialspark.streaming.ingest import hourly_counts

    base = "file://" + tempfile.mkdtemp(prefix="stored-")
    noon = datetime(2024, 3, 1, 12)
    at = lambda m: noon + timedelta(minutes=m)
    parts = [[at(10), at(59)], [at(65)], [at(56)], [at(72)], [at(50)], [at(200)], [at(201)]]  # 56: nine minutes late; 50: its hour is closed

    def start():
        events = spark.readStream.schema("ingest_ts timestamp, kind int").option("maxFilesPerTrigger", 1).json(f"{base}/in")
        return hourly_counts(events).writeStream.option("checkpointLocation", f"{base}/c").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").outputMode("append").start()

    for part in parts:
        spark.createDataFrame([(t, 1) for t in part], "ingest_ts timestamp, kind int").coalesce(1).write.mode("append").json(f"{base}/in")
        assert start().awaitTermination(120)
    got = {(r.hour - noon).total_seconds() / 3600: r.n for r in spark.read.schema("hour timestamp, kind int, n long").parquet(f"{base}/out").collect()}
    assert got == {0: 3, 1: 2}
