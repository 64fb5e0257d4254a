"""Insert views whose aggregates are kept as mergeable states.

A micro-batch gives a row of states for each target it touches: sketches of the actors who liked and reposted it (HLL,
``LG_K`` = 12: relative standard error 1.6 %), of the events that quote it, and exact sums of zaps. After ``fold`` batches the
states since the last base are merged with it into a new base. A read takes the newest base and the batches after it, so the
files it opens do not grow with the number of batches. A batch that runs again replaces its folder, or is left out if a base
holds it already.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.sources.ingest import note_zap
from socialspark.sources.scratch import exists, remove

LG_K = 12
#: Tasks that write a batch's states: a batch is a few files, and each task reports to the driver.
WRITERS = 8
SKETCHES = ("likers", "reposters", "quoters")
STATE = "target_event_id string, " + ", ".join(f"{s} binary" for s in SKETCHES) + ", sats long, zaps long"


def batch_states(events: DataFrame) -> DataFrame:
    """One row of states a target, of events that occur once: each event is read once and gives the rows of all that it names."""
    tag = lambda t, at: F.get(t, F.lit(at))
    names = lambda key: F.filter("tags", lambda t: (tag(t, 0) == key) & (F.octet_length(tag(t, 1)) == 64))
    row = lambda target, who, what, sats: F.struct(target.alias("target_event_id"), who.alias("who"), F.lit(what).alias("what"), sats.alias("sats"))
    act = lambda key, who, what: F.transform(names(key), lambda t: row(tag(t, 1), F.col(who), what, F.lit(None).cast("long")))
    zap = note_zap(F.col("tags"))
    kind = F.col("kind")
    acts = F.when(kind == 7, act("e", "pubkey", "like")).when(kind.isin(6, 16), act("e", "pubkey", "repost")).when(kind == 1, act("q", "id", "quote"))
    acts = acts.when((kind == 9735) & zap["target"].isNotNull(), F.array(row(zap["target"], F.col("id"), "zap", zap["sats"])))
    rows = events.select(F.explode(acts).alias("r")).select("r.*")
    sketch = lambda what: F.hll_sketch_agg(F.when(F.col("what") == what, F.col("who")), LG_K)
    some = lambda what, name: F.when(F.count_if(F.col("what") == what) > 0, sketch(what)).alias(name)
    return rows.groupBy("target_event_id").agg(
        some("like", "likers"), some("repost", "reposters"), some("quote", "quoters"), F.coalesce(F.sum("sats"), F.lit(0)).alias("sats"), F.count_if(F.col("what") == "zap").alias("zaps"))


def merged(states: DataFrame) -> DataFrame:
    """States of a target added up: sketches united, sums summed; partial before the shuffle."""
    return states.groupBy("target_event_id").agg(*[F.hll_union_agg(n).alias(n) for n in SKETCHES], F.sum("sats").alias("sats"), F.sum("zaps").alias("zaps"))


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Complete folders ``name=N`` under a path."""
    if not exists(spark, path):
        return []
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def _paths(spark: SparkSession, base: str) -> tuple[int, list[int], list[str]]:
    """(last batch of the newest base, batches after it, folders that hold both)."""
    upto = max(_numbers(spark, f"{base}/bases", "upto"), default=-1)
    after = [b for b in _numbers(spark, f"{base}/batches", "batch") if b > upto]
    return upto, after, ([f"{base}/bases/upto={upto}"] if upto >= 0 else []) + [f"{base}/batches/batch={b}" for b in after]


def read_states(spark: SparkSession, base: str) -> DataFrame:
    """The states of all batches so far, merged."""
    paths = _paths(spark, base)[2]
    return merged(spark.read.schema(STATE).parquet(*paths)) if paths else spark.createDataFrame([], STATE)


def counts(states: DataFrame) -> DataFrame:
    """(target_event_id, likes, reposts, quotes, sats, zaps); the first three are estimates of the sketches."""
    estimate = lambda c, name: F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).cast("long").alias(name)
    return states.select("target_event_id", estimate("likers", "likes"), estimate("reposters", "reposts"), estimate("quoters", "quotes"), "sats", "zaps")


def keep_states(base: str, fold: int = 8) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over events that occur once in the stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        upto, _, _ = _paths(spark, base)
        if batch_id <= upto:
            return
        batch_states(batch).coalesce(WRITERS).write.mode("overwrite").parquet(f"{base}/batches/batch={batch_id}")
        upto, after, paths = _paths(spark, base)
        if len(after) < fold:
            return
        merged(spark.read.schema(STATE).parquet(*paths)).write.mode("overwrite").parquet(f"{base}/bases/upto={after[-1]}")
        for path in paths:  # the new base is complete; what it holds goes
            remove(spark, path)

    return write
