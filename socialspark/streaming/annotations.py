"""Annotation with failures by event: what one event breaks costs that event alone.

A processor is a function from a pandas frame of events to metric rows (event_id, metric, value). It gets batches of at
most ``size`` events inside tasks. If it raises, or names an event that it was not given, the batch is halved until the
event that fails stands alone and goes to the failures, with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SIZE = 256
OUTCOME = "event_id string, metric string, value double, error string, outcome string"
Processor = Callable[[pd.DataFrame], pd.DataFrame]


def settled(events: pd.DataFrame, process: Processor) -> Iterator[pd.DataFrame]:
    """Outcome rows of some events: metric rows, ``skipped`` for events without any, ``failed`` with the error."""
    try:
        rows = process(events)[["event_id", "metric", "value"]].astype({"event_id": str, "metric": str, "value": float})
        if strangers := set(rows["event_id"]) - set(events["id"]):
            raise ValueError(f"rows for events that were not in the batch: {sorted(strangers)[:3]}")
    except Exception as e:  # whatever a processor raises belongs to one of its events
        if len(events) == 1:
            yield pd.DataFrame({"event_id": events["id"], "metric": None, "value": None, "error": f"{type(e).__name__}: {e}", "outcome": "failed"})
            return
        half = len(events) // 2
        yield from settled(events.iloc[:half], process)
        yield from settled(events.iloc[half:], process)
        return
    without = events.loc[~events["id"].isin(rows["event_id"]), "id"]
    yield rows.assign(error=None, outcome="metric")
    yield pd.DataFrame({"event_id": without, "metric": None, "value": None, "error": None, "outcome": "skipped"})


def outcomes(events: DataFrame, process: Processor, size: int = SIZE) -> DataFrame:
    """One pass over the events: every event has metric rows, or one row that says it was skipped or failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), size):
                for rows in settled(frame.iloc[first : first + size], process):
                    if len(rows):
                        yield rows[["event_id", "metric", "value", "error", "outcome"]]

    return events.mapInPandas(run, OUTCOME)


def annotate_each(base: str, process: Processor, size: int = SIZE) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: outcomes of a batch are written once, by outcome; a write that fails fails the batch,
    so the checkpoint does not move, and the batch's folder is replaced when it runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates(["id"])
        outcomes(once, process, size).write.mode("overwrite").option("compression", "zstd").partitionBy("outcome").parquet(f"{base}/outcomes/batch={batch_id}")

    return write


def read_outcomes(spark: SparkSession, base: str) -> DataFrame:
    """All outcomes so far; ``outcome = 'failed'`` is the failures table."""
    return spark.read.schema(f"{OUTCOME}, batch int").parquet(f"{base}/outcomes")
