"""Connected components of an edge list as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.sources.scratch import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of ``edges`` (a, b); label is the component's smallest node.

    Labels take the smallest label among a node's neighbours, then jump to their label's label, until
    none changes. Each round's labels are written, so a lost executor costs one round at most; joins
    read plain tables on both sides, so adaptive execution can split a node with very many edges.
    No edges give no rows; self-loops and repeats do no harm; edges with a null end are left out.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = cut(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was")), "labels")
        up = lower.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = cut(lower.join(up, lower["label"] == up["up"]).select("node", F.col("up_label").alias("label"), "was"), "labels")
        discard(labels)
        discard(lower)
        labels = jumped.select("node", "label")
        labels.scratch_path = jumped.scratch_path
        if not jumped.where("label <> was").limit(1).count():
            discard(both)
            return labels
