"""The canonical events: numbers travel, what is worked out of them does not."""

import hashlib

from socialspark.plans.fixtures import Tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_numbers_are_shuffled(spark, tmp_path):
    rows = spark.range(200).where("id <> 31").selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "id % 7 AS user_id", "'click' AS event_type", "1.5D AS value", "'' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    plan = _plan(t._numbers())
    assert "BroadcastExchange" not in plan and "sha2" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert "Exchange" not in _plan(t.canonical(t.numbers))
    ev = {r.event_id: r for r in t.events.collect()}
    assert sorted(ev) == [i for i in range(200) if i != 31]
    key = lambda prefix, x: hashlib.sha256(f"{prefix}{x}".encode()).hexdigest()
    for i, r in ev.items():
        if r.kind in (6, 7):
            n = i * 31 % 80
            target = 10 * (n // 4) + n % 4
            assert r.tags[0][1] == key("e", target) and r.tags[1] == ["p", None if target == 31 else key("u", target % 7)]
