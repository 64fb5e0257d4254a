"""Streams of many micro-batches give what one batch gives."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from socialspark import registry
from socialspark.operators import jobs
from socialspark.plans import backfill
from socialspark.plans.fixtures import Tables
from socialspark.streaming import ingest as st

SF = "/root/testdata/sf0.001"


@pytest.fixture
def one_file_a_batch(spark, monkeypatch):
    read = backfill.st.read_folder
    monkeypatch.setattr(backfill.st, "read_folder", lambda spark, path, files_per_batch: read(spark, path, 1))
    several_files = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in several_files.items():
        spark.conf.set(name, value)
    yield
    for name in several_files:
        spark.conf.unset(name)


def test_no_event_is_late(spark, one_file_a_batch):
    got = sorted(r.id for r in registry.queries()["st3_ahead_of_time"](spark, SF).collect())
    assert got == sorted(r.id for r in Tables(spark, SF).events.where("event_id % 50 < 48").select("id").collect())


def test_cap_keeps_the_first_of_a_day(spark, one_file_a_batch):
    t = Tables(spark, SF)
    exempt = {r.pubkey for r in jobs.scored_actors(t.scores, 90).collect()}
    seen, want = {}, []
    for r in sorted(t.events.where("event_id % 50 < 48").select("id", "pubkey", "kind", "created_at").collect(), key=lambda r: (r.created_at, r.id)):
        if r.kind in (1, 6, 16, 1111) and r.pubkey not in exempt:
            day = r.pubkey, r.created_at.date()
            seen[day] = seen.get(day, 0) + 1
            if seen[day] > 2:
                continue
        want.append(r.id)
    assert sorted(r.id for r in registry.queries()["st4_stream_daily_cap"](spark, SF).collect()) == sorted(want)


def test_states_of_the_cap_do_not_grow_with_author_days(spark):
    base = "file://" + tempfile.mkdtemp(prefix="cap-states-")
    noon = datetime(2024, 3, 1, 12)
    for part in range(2):  # each of 300 authors posts three times, before a reaction
        rows = [(f"{part}-{n}-{a:03d}", f"a{a}", 7 if n == 3 else 1, noon + timedelta(minutes=part * 9 + n)) for a in range(150 * part, 150 * part + 150) for n in range(4)]
        rows += [(f"{part}-late", "a0", 1, noon + timedelta(minutes=20 + part))]
        spark.createDataFrame(rows, "id string, pubkey string, kind int, ingest_ts timestamp").coalesce(1).write.mode("append").json(f"{base}/in")
    events = spark.readStream.schema("id string, pubkey string, kind int, ingest_ts timestamp").option("maxFilesPerTrigger", 1).json(f"{base}/in")
    exempt = spark.createDataFrame([("a299",)], "pubkey string")
    q = st.micro_batches(st.capped(events, exempt, 2, buckets=8).select("id"), f"{base}/state", once=True).format("parquet").option("path", f"{base}/out").start()
    assert q.awaitTermination(120)
    got = sorted(r.id for r in spark.read.schema("id string").parquet(f"{base}/out").collect())
    assert got == sorted([f"{a // 150}-{n}-{a:03d}" for a in range(300) for n in (0, 1, 3)] + ["1-2-299"])
    assert spark.read.format("statestore").load(f"{base}/state").count() <= 8
