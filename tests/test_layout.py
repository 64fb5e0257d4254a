"""Joins of bucketed tables move neither table."""

from socialspark.operators import layout
from socialspark.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_hydration_has_no_exchange(spark, capsys):
    t = Tables(spark, SF)
    tags, events = layout.bucketed(t.tags, "tags_by_event", "event_id", 8), layout.bucketed(t.events.select("id", "kind", "content"), "events_by_id", "id", 8)
    assert len(events.inputFiles()) <= 8
    out = layout.hydrated(tags.where("tag_key = 'e'"), events, "content")
    text = plan(out, capsys)
    assert "SortMergeJoin" in text and "Exchange" not in text and "Broadcast" not in text
    want = t.tags.where("tag_key = 'e'").join(t.events.selectExpr("id AS event_id", "content"), "event_id").select("event_id", "tag_index", "content")
    assert sorted(map(tuple, out.select("event_id", "tag_index", "content").collect())) == sorted(map(tuple, want.collect()))
    both = plan(layout.both_sides(tags.where("tag_key = 'e'"), events, "content"), capsys)
    assert both.count("Exchange") == 1
