"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Targets: each source gets ``share`` x all words by weight, at most ``most`` x its own words; the excess
is shared again by weight (water filling, in closed form over the sources sorted by cap / weight).
Blocks of ``block`` words are then allocated to sources by the highest quotients target / (2k + 1), and
within a source to its shards in the same way; each shard's documents, in the order of a seeded hash,
form a tape of blocks, read from its start and again from its start, until the shard's quota is met.

Sources with any share of the rows are cut to shards of about ``shard_docs`` documents; beyond ``shards``
per source they hold more, up to ``most_docs``, and from there on their number grows with the source. So no
task gets a source as a whole. Seats are not handed out one by one: every
quotient's rank is within a few seats of target / block, so only those few are ranked.

Defined cases: null text has size 0; in :func:`apply_mix` documents of size 0 take no words and
leave, null doc_ids are ids like others; null is a source of its own, after all others; sources of size 0
get target 0; rows that repeat a doc_id are separate documents (ties in the hash go by size, and equal
rows get equal shares or one more block than their twin); an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from socialspark.sources.scratch import cut

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, n_docs, target. The windows run over sources, not documents."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    t = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    everyone = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    t = t.withColumn("wanted", share * F.sum("source_size").over(everyone).cast("double"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest
    t = t.withColumn("level", level)  # the water level if exactly the sources before this one are full
    t = t.withColumn("water", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everyone))
    return t.select("source", "source_size", "n_docs", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target"))


def apportion(parties: DataFrame, within: list[str], key: list[str], seats: str, target: str, out: str) -> DataFrame:
    """Sainte-Laguë: add ``out``, each party's share of its group's ``seats`` by the highest quotients target / (2k + 1).

    With n parties and N seats a party's seats differ from N * target / total by no more than the final
    divisor's move, which n / 2 seats bound; seats below that band are sure, those in it are ranked.
    """
    group = Window.partitionBy(*within)
    fair = F.when(F.col("_sum") > 0, F.col(target) / F.col("_sum") * F.col(seats)).otherwise(F.lit(0.0))
    p = parties.withColumn("_sum", F.sum(target).over(group)).withColumn("_n", F.count("*").over(group)).withColumn("_fair", fair)
    slack = F.when(F.col("_sum") > 0, F.col(target) / F.col("_sum") * F.col("_n") / 2).otherwise(F.lit(0.0)) + 1
    p = p.withColumn("_sure", F.greatest(F.floor(F.col("_fair") - slack), F.lit(0)).cast("long"))
    p = p.withColumn("_most", F.ceil(F.col("_fair") + slack).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    names = parties.columns
    seat = p.where(F.col(target) > 0).withColumn("_k", F.explode(F.sequence("_sure", "_most")))
    best = Window.partitionBy(*within).orderBy((F.col(target) / (2 * F.col("_k") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], "_k")
    won = seat.withColumn("_rank", F.row_number().over(best)).groupBy(*names).agg(
        F.max("_sure").alias("_base"), F.sum((F.col("_rank") <= F.col("_left")).cast("long")).alias("_extra"))
    return won.select(*names, (F.col("_base") + F.col("_extra")).alias(out))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 16, seed: int = 7, shard_docs: int = 64, shards: int = 4096, most_docs: int = 1_000_000, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken (words the mix takes, repeats counted).

    ``keep`` adds columns computed from ``docs``; they also end ties on the tape.
    """
    more = list(keep or {})
    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count("text").alias("size"), *[c.alias(name) for name, c in (keep or {}).items()])
    sizes = cut(slim.withColumn("mark", F.xxhash64(F.lit(seed), "doc_id", "size")), "mix-sizes")
    goal = targets(sizes, weights, share, most)
    goal = goal.withColumn("n_shards", F.least(F.greatest(F.lit(shards), F.ceil(F.col("n_docs") / most_docs)), F.ceil(F.col("n_docs") / shard_docs)).cast("int"))
    total = goal.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    quota = apportion(total, [], ["source"], "blocks", "target", "source_blocks")
    goal = cut(goal.alias("g").join(quota.alias("q"), F.col("g.source").eqNullSafe(F.col("q.source")), "left").select("g.*", F.coalesce("q.source_blocks", F.lit(0)).cast("long").alias("source_blocks")), "mix-goals")
    shard = F.pmod(F.shiftright("mark", 20), F.col("n_shards")).alias("shard")
    dealt = sizes.alias("s").join(F.broadcast(goal) if goal.count() <= 10_000 else goal, sizes["source"].eqNullSafe(goal["source"]))
    dealt = dealt.select("doc_id", goal["source"], "size", "mark", shard, "source_size", "target", "source_blocks", *more)
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"), F.first("source_size").alias("source_size"), F.first("source_blocks").alias("source_blocks"))
    cells = cells.withColumn("weight", F.col("cell_size").cast("double"))
    quotas = apportion(cells.select("source", "shard", "cell_size", "source_blocks", "weight"), ["source"], ["shard"], "source_blocks", "weight", "quota")
    quotas = cut(quotas.select("source", "shard", "cell_size", "quota"), "mix-quotas")
    tape = Window.partitionBy("source", "shard").orderBy("mark", "doc_id", "size", *more)
    placed = dealt.withColumn("end", F.sum("size").over(tape.rowsBetween(Window.unboundedPreceding, 0)))
    j = placed.join(quotas.withColumnsRenamed({"source": "q_source", "shard": "q_shard"}), F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
    words = F.least(F.coalesce(F.col("quota"), F.lit(0)) * block, (F.col("cell_size") * most).cast("long"))
    j = j.withColumn("words", F.coalesce(words, F.lit(0)))
    whole = F.when(F.col("cell_size") > 0, F.floor(F.col("words") / F.col("cell_size"))).otherwise(F.lit(0))
    part = F.when(F.col("cell_size") > 0, F.col("words") % F.col("cell_size")).otherwise(F.lit(0))
    begin = F.col("end") - F.col("size")
    again = F.greatest(F.least(F.col("end"), part) - begin, F.lit(0))
    return j.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + again).cast("long").alias("taken"), *more)


def apply_mix(docs: DataFrame, **params) -> DataFrame:
    """Rows of the mix, with the columns of ``docs``: each document as many times as its taken words round to whole copies.

    Quotas go back to the rows by id (null too), source, size and a hash of the text; rows equal in all four are
    numbered on both sides, so each row takes one quota.
    """
    names = docs.columns
    own = [f"c{k}" for k in range(len(names))]  # free of clashes with the columns added
    at = dict(zip(names, own, strict=True))
    key = ["_id", "_source", "_size", "_text"]
    marked = docs.toDF(*own).withColumns({"_id": F.col(at["doc_id"]).cast("long"), "_source": F.col(at["source"]).cast("string"), "_size": word_count(at["text"]), "_text": F.xxhash64(at["text"])})
    same = Window.partitionBy(*key)
    rest = [F.col(at[c]) for c in names if c not in ("doc_id", "source", "text")]
    rows = marked.where("_size > 0").withColumn("_nth", F.row_number().over(same.orderBy(*rest) if rest else same.orderBy("_size")))
    taken = mix(docs, keep={"_text": F.xxhash64("text")}, **params).where("size > 0")
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_text", F.round(F.col("taken") / F.col("size")).cast("int").alias("_n"))
    taken = taken.withColumn("_nth", F.row_number().over(same.orderBy(F.desc("_n"))))
    r, t = rows.alias("r"), taken.alias("t")
    equal = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*key, "_nth")]
    kept = r.join(t, reduce(Column.__and__, equal)).where("t._n > 0").select("r.*", "t._n")
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*own).toDF(*names)
