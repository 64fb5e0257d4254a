"""Stream runs over more input than small data has."""

from types import SimpleNamespace

import duckdb

from socialspark.plans import backfill
from socialspark.plans.fixtures import Tables


class Slow:
    """A run that takes longer than any limit it is given."""

    ended = stopped = False

    def awaitTermination(self, timeout=None):  # noqa: N802
        self.ended = timeout is None
        return self.ended

    def stop(self):
        self.stopped = True


def test_a_run_may_take_as_long_as_its_input_needs(monkeypatch):
    query = Slow()
    monkeypatch.setattr(backfill, "new_path", lambda spark, label: "/base")
    monkeypatch.setattr(backfill, "_frames", lambda t, **order: None)
    monkeypatch.setattr(backfill, "st", SimpleNamespace(write_folder=lambda *_: None, in_file_order=lambda *_: None, read_folder=lambda *_: None))
    assert backfill._stream(SimpleNamespace(spark=None), lambda frames, base: query) == "/base"
    assert query.ended and not query.stopped


def test_files_follow_the_rows_not_the_ids(spark, tmp_path):
    """Ids with gaps, as in a copy with keys shifted by much."""
    duckdb.sql(f"COPY (SELECT 1000003 * (i // 1000) + i % 1000 AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i % 90 AS user_id, 'click' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM range(60000) AS r(i)) TO '{tmp_path}/events.parquet'")
    t = Tables(spark, f"file://{tmp_path}")
    assert t.bounds.n > 59_000_000 and t.bounds.rows == 60_000
    assert backfill._files(t) == backfill.FRAME_FILES
    assert backfill.in_time(t).rdd.getNumPartitions() == backfill.FRAME_FILES


def test_a_large_batch_comes_in_several_files():
    t = lambda rows: SimpleNamespace(bounds=SimpleNamespace(rows=rows, n=rows))
    got = [(backfill._files(t(n)), backfill._pieces(t(n)), backfill._batches(t(n))) for n in (1_000, 100_000, 6_000_000, 36_000_000)]
    assert got == [(8, 1, 8), (8, 1, 8), (24, 8, 12), (144, 8, 72)]


def test_batches_follow_the_rows_not_the_files(monkeypatch):
    """Frames may be laid in more files than asked for."""
    asked = []
    monkeypatch.setattr(backfill, "new_path", lambda spark, label: "/base")
    monkeypatch.setattr(backfill, "_frames", lambda t, **order: None)
    for files in (0, 5, 8, 211):
        monkeypatch.setattr(backfill, "st", SimpleNamespace(write_folder=lambda *_: None, in_file_order=lambda *_, n=files: n, read_folder=lambda spark, path, n: asked.append(n)))
        backfill._stream(SimpleNamespace(spark=None), lambda frames, base: Slow(), batches=8)
    assert asked == [1, 1, 1, 27]
