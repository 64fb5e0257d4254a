"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.operators.jobs import like_counts
from socialspark.plans import backfill, core, running, social
from socialspark.plans.fixtures import Tables

_PARTS = (core, social, backfill, running)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by distinct likers."""
    return like_counts(Tables(spark, sf_dir).tags).orderBy(F.desc("likes"), "target_event_id").limit(100)
