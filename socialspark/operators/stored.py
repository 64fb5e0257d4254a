"""Retention on stored tables: only partitions that lose rows are written again, empty ones are dropped.

A table is a folder of partitions by one column (months of the event log, days of a derived table). Rows that stay are
marked by their place, a bit for each row of a file, so that finding them moves only the columns a rule compares, and
several rules end in one rewrite. Spark replaces the partitions that lose rows when all of them are written (dynamic
overwrite), then partitions without survivors go; if that is interrupted, running the rules again ends in the same table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.operators.retention import LIFETIMES
from socialspark.sources.scratch import cut, discard


#: Rows of a file that one bitmap holds: what ``bitmap_construct_agg`` takes.
BLOCK = 32_768


@dataclass(frozen=True)
class Change:
    """Partitions that lost some of their rows, that lost all, and rows removed."""

    rewritten: tuple[str, ...]
    dropped: tuple[str, ...]
    removed: int


def read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as it is now; the file list is taken anew."""
    spark.catalog.refreshByPath(path)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def partitions(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the partition column, from the folder names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def drop_partitions(spark: SparkSession, path: str, column: str, values: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for value in values:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _placed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows with the file they lie in and their number in it."""
    return read_stored(spark, path, schema).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _marks(rows: DataFrame, column: str) -> DataFrame:
    """(partition, _file, _block, bits): a bit for each of some placed rows, 4 KB for 32,768 rows of a file."""
    return rows.groupBy(column, "_file", F.expr(f"_row DIV {BLOCK}").alias("_block")).agg(F.bitmap_construct_agg(F.col("_row") % BLOCK).alias("bits"))


def _marked(rows: DataFrame, marks: DataFrame, kept: bool = True) -> DataFrame:
    """Placed rows whose bit is set, or those whose bit is not."""
    bits = marks.select("_file", F.col("_block"), "bits")
    bit = F.expr(f"shiftright(cast(conv(hex(substring(bits, cast(_row % {BLOCK} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT), cast(_row % 8 AS INT)) & 1")
    j = rows.withColumn("_block", F.expr(f"_row DIV {BLOCK}")).join(F.broadcast(bits), ["_file", "_block"], "inner" if kept else "left")  # one bit a row of the table
    return j.where(bit == 1 if kept else F.col("bits").isNull() | (bit == 0)).select(*rows.columns)


def _per_partition(marks: DataFrame, column: str) -> dict[str, int]:
    return {r[0]: r.n for r in marks.groupBy(column).agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}


def _sizes(table: DataFrame, column: str) -> dict[str, int]:
    return {r[0]: r.n for r in table.groupBy(column).agg(F.count("*").alias("n")).collect()}


def _replace(spark: SparkSession, path: str, column: str, rows: DataFrame, layout: list[str]) -> None:
    """Partitions of placed rows are written again with these rows alone; files are read in place and no row is shuffled."""
    rows.drop("_file", "_row").sortWithinPartitions(column, *layout).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(column).parquet(path)


def _change(before: dict[str, int], after: dict[str, int]) -> Change:
    rest, empty = sorted(v for v in before if 0 < after.get(v, 0) < before[v]), sorted(v for v in before if not after.get(v, 0))
    return Change(tuple(rest), tuple(empty), sum(before.values()) - sum(after.values()))


def remove(spark: SparkSession, path: str, schema: str, column: str, key: list[str], doomed: DataFrame, layout: list[str]) -> Change:
    """Remove the rows whose key is in ``doomed``. ``column`` is the partition column, a string; ``layout`` the order
    inside files. Partitions are told from the counts of removed and of all rows, one row a partition."""
    table = _placed(spark, path, schema)
    gone = cut(_marks(table.join(doomed.select(*key).distinct(), key, "left_semi"), column), "removed-rows")
    hit = _per_partition(gone, column)
    if not hit:
        discard(gone)
        return Change((), (), 0)
    some = table.where(F.col(column).isin(*hit))  # prunes to the folders that lose rows
    total = _sizes(some, column)
    change = _change(total, {v: n - hit[v] for v, n in total.items()})
    if change.rewritten:
        _replace(spark, path, column, _marked(table.where(F.col(column).isin(*change.rewritten)), gone, kept=False), layout)
    drop_partitions(spark, path, column, list(change.dropped))
    discard(gone)
    return change


def apply_rules(spark: SparkSession, path: str, schema: str, rules: dict[str, Callable[[DataFrame], DataFrame]], min_matched: int = 1, column: str = "month") -> dict[str, Change]:
    """Retention rules one after another on the stored event log. A rule gives the survivors of a log, with its columns or at
    least their ids; one that would remove fewer than ``min_matched`` rows leaves the log alone. Each rule sees what those
    before it left, by marks; what all of them removed goes in one rewrite at the end. A rule's change names the partitions
    that it takes rows from."""
    table = _placed(spark, path, schema)
    given = left = _sizes(table, column)
    out, kept = {}, None
    for name, survivors in rules.items():
        log = table if kept is None else _marked(table, kept)
        rows = survivors(log)
        if "_row" not in rows.columns:
            rows = log.join(rows.select("id").distinct(), "id", "left_semi")
        marks = cut(_marks(rows, column), "survivors")
        now = _per_partition(marks, column)
        acts = sum(left.values()) - sum(now.values()) >= max(min_matched, 1)
        out[name] = _change(left, now) if acts else Change((), (), 0)
        if acts:
            marks, kept, left = kept, marks, now
        if marks is not None:
            discard(marks)
    if kept is not None:
        whole = _change(given, left)
        if whole.rewritten:
            _replace(spark, path, column, _marked(table.where(F.col(column).isin(*whole.rewritten)), kept), ["kind", "created_at", "pubkey", "id"])
        drop_partitions(spark, path, column, list(whole.dropped))
        discard(kept)
    return out


def expire(spark: SparkSession, path: str, schema: str, table: str, as_of: Column, time: str, layout: list[str], column: str = "day") -> Change:
    """Give up rows of a derived table past its lifetime: whole days go by folder, unread; the day of the bound is written again."""
    bound = spark.range(1).select((as_of - F.expr(f"INTERVAL {LIFETIMES[table]} DAYS")).cast("timestamp_ntz").alias("at")).first().at
    edge = bound.strftime("%Y-%m-%d")
    days = partitions(spark, path, column)
    old = [d for d in days if d < edge]
    drop_partitions(spark, path, column, old)
    if edge not in days:
        return Change((), tuple(old), 0)
    day = read_stored(spark, path, schema).where(F.col(column) == edge)
    counts = day.agg(F.count("*").alias("n"), F.count_if(F.col(time) > F.lit(bound)).alias("kept")).first()
    if counts.kept == counts.n:
        return Change((), tuple(old), 0)
    if not counts.kept:
        drop_partitions(spark, path, column, [edge])
        return Change((), (*old, edge), counts.n)
    staged = cut(day.where(F.col(time) > F.lit(bound)), "unexpired")
    staged.hint("rebalance", column).sortWithinPartitions(*layout).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    discard(staged)
    return Change((edge,), tuple(old), counts.n - counts.kept)
