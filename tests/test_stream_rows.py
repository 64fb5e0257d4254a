"""Rows of a stream: parsed once, kept without a shuffle, the same after they were packed."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from socialspark.functions.text import packed, unpacked
from socialspark.sources.ingest import decode_frames
from socialspark.streaming import ingest as st

A, B, T = "a" * 64, "b" * 64, "0f" * 32
EVENT = {"id": A, "pubkey": B, "created_at": 1704067200, "kind": 7, "tags": [["e", T, "", ""], ["p", "A" * 64], []], "content": "+", "sig": "0" * 128}
LINES = [json.dumps(["EVENT", "s", EVENT]), json.dumps(["EVENT", "s", EVENT])[:-1], '["EOSE","s"]', json.dumps(["NOTE", "s", EVENT]), "null", None, '["EVENT","s",{}]']


def _frames(spark):
    return spark.createDataFrame([(x, "r", datetime(2024, 1, 1)) for x in LINES], "value string, relay string, ingest_ts timestamp")


def test_a_line_is_parsed_once(spark):
    valid = st.valid_events(_frames(spark))
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField") + plan.count("from_json(ArrayType") == 2, plan
    assert [(r.id, r.kind, r.tags) for r in valid.collect()] == [(A, 7, EVENT["tags"])]
    assert decode_frames(_frames(spark)).columns == ["relay", "ingest_ts", "id", "pubkey", "created_at", "kind", "tags", "content", "sig"]


def test_views_keep_repeats_apart_until_they_are_read(spark, tmp_path):
    batch = st.valid_events(_frames(spark))
    batch = batch.unionByName(batch)
    assert "Exchange" not in st.VIEWS["candidates"](batch)._jdf.queryExecution().executedPlan().toString()
    for n in range(2):
        st.write_views(str(tmp_path), ("events", "likes", "candidates"))(batch, n)
    read = lambda name, schema: [tuple(r) for r in st.read_view(spark, str(tmp_path), name, schema).collect()]
    assert read("events", "id string, kind int") == [(A, 7)]
    assert read("likes", "target_event_id string, pubkey string") == [(T, B)]
    assert read("candidates", "viewer string, event_id string, reason string") == [("A" * 64, A, "reaction")]


def test_tags_come_back_as_they_were(spark):
    rows = spark.createDataFrame([([["e", A], [], ["", None, "A" * 64, "ü" * 64, A + "\n", "\0"]],), ([],), (None,)], "tags array<array<string>>")
    there = rows.withColumn("back", F.transform("tags", lambda t: F.transform(F.transform(t, packed), unpacked)))
    assert all(r.tags == r.back for r in there.collect())
