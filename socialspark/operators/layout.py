"""Tables bucketed by a join key: joins on it read matching buckets side by side and shuffle neither table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.sources.scratch import new_path

BUCKETS = 64


def bucketed(df: DataFrame, label: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` written in ``buckets`` buckets of ``key``, sorted by it inside; one file a bucket, as the rows are dealt out in
    the same way first. Rows of one key lie in one bucket, so the key should be one that no value holds much of (an id)."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key).sortWithinPartitions(key)
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", new_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def hydrated(tags: DataFrame, events: DataFrame, *columns: str) -> DataFrame:
    """Tag rows with ``columns`` of their own events, both tables bucketed by the event's id: a merge join without an exchange."""
    own = events.select(F.col("id").alias("event_id"), *columns).hint("merge")
    return tags.join(own, "event_id")


def both_sides(tags: DataFrame, events: DataFrame, column: str) -> DataFrame:
    """(event_id, target_id, source_<column>, target_<column>) of tag rows: the source's side is joined in place, and only the
    tag rows move to the targets' buckets."""
    source = hydrated(tags.select("event_id", F.col("tag_value").alias("target_id")), events, column).withColumnRenamed(column, f"source_{column}")
    target = events.select(F.col("id").alias("target_id"), F.col(column).alias(f"target_{column}"), F.col("kind").alias("target_kind")).hint("merge")
    return source.join(target, "target_id")
