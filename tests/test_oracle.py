"""SQL twins on more targets than small data has."""

import duckdb

from socialspark import registry

NOTES = 51_000


def test_all_engaged_targets_count_in_the_sql():
    con = duckdb.connect()
    # every run of ten ids has four notes and two reactions; two of the notes and all reactions engage others
    con.execute(f"CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-30 12:00:00' AS ts, i % 100 AS user_id, 'click' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM range({NOTES // 4 * 10 * 2}) AS r(i)")
    body = registry.oracle_sql()["m8_note_engagement_real"]
    assert con.execute(f"SELECT count(*) > 50000, count(*) = count(DISTINCT event_id) FROM ({body})").fetchone() == (True, True)


def test_no_twin_of_a_roll_up_stops_at_a_number_of_targets():
    bodies = registry.oracle_sql()
    for name in ("m8_note_engagement_real", "m9_note_rank_features", "r1_feature_ranking", "r4_routed_rankings", "st11_rollup_tick"):
        assert "LIMIT 50000" not in bodies[name], name
