"""Depths and subtree sizes by pointer doubling against plain recursion."""

import random

from pyspark.sql import functions as F

from socialspark.operators import graph


def brute(up):
    nodes = set(up) | set(up.values())
    depth, size = {}, dict.fromkeys(nodes, 0)
    for n in nodes:
        path, at = [n], n
        while at in up and up[at] not in path:
            at = up[at]
            path.append(at)
        depth[n] = len(path) - 1
        for a in path[1:]:
            size[a] += 1
    return {(n, depth[n], size[n]) for n in nodes}


def links(spark, up):
    return spark.createDataFrame([(str(a), str(b)) for a, b in up.items()], "id string, up string")


def got(df):
    return {(int(r.id), r.depth, r.descendants) for r in df.collect()}


def test_random_forests_stars_and_cycles(spark):
    r = random.Random(5)
    up = {n: r.randrange(n) for n in range(1, 150) if n % 40}
    up |= {200 + k: 199 for k in range(80)} | {300 + k: 299 + k for k in range(1, 70)}
    up |= {500: 501, 501: 502, 502: 500, 510: 500, 511: 510, 512: 510, 513: 501, 520: 520, 530: 531, 531: 530}  # cycles, what hangs on them, a node above itself
    tree, _ = graph.forest(links(spark, up))
    assert got(tree) == brute(up)


def test_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    chain = spark.range(1, n).select(F.col("id").cast("string").alias("id"), (F.col("id") - 1).cast("string").alias("up"))
    tree, rounds = graph.forest(chain)
    assert rounds < 25
    wrong = tree.where((F.col("depth") != F.col("id").cast("long")) | (F.col("descendants") != n - 1 - F.col("id").cast("long")))
    assert wrong.count() == 0 and tree.count() == n


def test_no_links(spark):
    assert graph.forest(spark.createDataFrame([], "id string, up string"))[0].count() == 0
