"""Reference graph: hops, walks, chains, threads."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from socialspark.functions.tags import TagPredicate, root_ref
from socialspark.functions.text import packed, unpacked
from socialspark.operators.latest import latest, ranked, top_per_key
from socialspark.sources.scratch import cut, discard


def forward_references(sources: DataFrame, events: DataFrame, predicate: TagPredicate, limit: int) -> DataFrame:
    """(source_id, target_id, position): events that a source's tags name, first occurrence of each, in order."""
    r = sources.select(F.col("id").alias("source_id"), F.posexplode(F.slice(F.array_distinct(predicate.values_of(F.col("tags"))), 1, limit)).alias("position", "target_id"))
    return r.join(events.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "position")


def referenced_by(parents: DataFrame, tags: DataFrame, key: str = "e", target: Column | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    """(parent_id, event_id, position): newest events with a tag of ``key`` whose value is the parent's id (or ``target``: a pubkey or an address)."""
    p = parents.select(F.col("id").alias("parent_id"), (target if target is not None else F.col("id")).alias("tag_value"))
    rows = tags.where(F.col("tag_key") == key).select("tag_value", "event_id", "created_at").distinct().join(p, "tag_value")
    return top_per_key(rows, ["parent_id"], [F.desc("created_at"), F.desc("event_id")], limit, offset, name="position").select("parent_id", "event_id", "position")


def walk(sources: DataFrame, links: DataFrame, depth: int | None = 8) -> DataFrame:
    """(source_id, event_id, step): follow (event_id, next_id) links from each source, once to each event.

    One join a step over what is left; steps are written, and the walk stops where no source goes on, or
    after ``depth`` steps if that is given.
    """
    links = cut(links.select("event_id", "next_id"), "links")
    front = sources.select(F.col("id").alias("source_id"), F.col("id").alias("event_id"), F.array("id").alias("seen"))
    steps: list[DataFrame] = []
    for step in count(1) if depth is None else range(1, depth + 1):
        nxt = front.join(links, "event_id").where(~F.array_contains("seen", F.col("next_id")))
        front = cut(nxt.select("source_id", F.col("next_id").alias("event_id"), F.concat("seen", F.array("next_id")).alias("seen")), "walk")
        if not front.limit(1).count():
            break
        steps.append(front.select("source_id", "event_id", F.lit(step).alias("step")))
    empty = sources.select(F.col("id").alias("source_id"), F.col("id").alias("event_id"), F.lit(0).alias("step")).limit(0)
    out = empty
    for s in steps:
        out = out.unionByName(s)
    return out


def resolve_roots(events: DataFrame, hops: int = 8) -> DataFrame:
    """(id, root_id): up the root references while they lead to a known event; an unknown root keeps its id."""
    refs = events.select(F.col("id").alias("event_id"), root_ref(F.col("tags"), F.col("id")).alias("next_id")).where("next_id IS NOT NULL")
    steps = walk(events.select("id"), refs, hops)
    last = latest(steps, ["source_id"], [F.desc("step")])
    return events.select("id").join(last.select(F.col("source_id").alias("id"), F.col("event_id").alias("root_id")), "id", "left").select("id", F.coalesce("root_id", "id").alias("root_id"))


def first_own_reply(edges: DataFrame) -> DataFrame:
    """(parent_id, author, child_id): the earliest reply of each author to each parent."""
    e = edges.select("parent_id", F.col("child_pubkey").alias("author"), "child_id", "created_at")
    return latest(e, ["parent_id", "author"], [F.asc("created_at"), F.asc("child_id")]).select("parent_id", "author", "child_id")


def authored_chain(roots: DataFrame, edges: DataFrame, depth: int = 8, allowed: DataFrame | None = None, via: Column | None = None, fan_out: int = 1) -> DataFrame:
    """(root_id, event_id, step): from each root (id, pubkey) the author's earliest reply, its earliest reply, and so on.

    ``allowed`` gives other authors, for each root (root_id, author) or for all roots (author); then the earliest reply of
    any of them is taken. ``via`` is a condition on the edges to go along, ``fan_out`` the number of replies a step takes.
    """
    depth = min(depth, 64)
    if via is not None:
        edges = edges.where(via)
    common = allowed is not None and "root_id" not in allowed.columns
    if common:
        edges = edges.join(allowed.select(F.col("author").alias("child_pubkey")).distinct(), "child_pubkey", "left_semi")
    if allowed is None:
        allowed = roots.select(F.col("id").alias("root_id"), F.col("pubkey").alias("author"))
    replies = cut(edges.select("parent_id", F.col("child_pubkey").alias("author"), "child_id", "created_at"), "replies")
    front = roots.select(F.col("id").alias("root_id"), F.col("id").alias("event_id"))
    seen = front
    out = None
    for step in range(1, depth + 1):
        nxt = front.join(replies, front["event_id"] == replies["parent_id"])
        if not common:
            nxt = nxt.join(allowed, ["root_id", "author"], "left_semi")
        nxt = nxt.select("root_id", F.col("child_id").alias("event_id"), "created_at").join(seen, ["root_id", "event_id"], "left_anti")
        front = cut(top_per_key(nxt, ["root_id"], [F.asc("created_at"), F.asc("event_id")], fan_out).select("root_id", "event_id"), "chain")
        part = front.withColumn("step", F.lit(step))
        out = part if out is None else out.unionByName(part)
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return out


def expand_threads(roots: DataFrame, tags: DataFrame, levels: int | None = 8) -> DataFrame:
    """(root_id, event_id, level): notes and comments that reference a seen node, level by level, each at its lowest level.

    A level takes all events that a root has there; the walk stops where no root goes on, or after ``levels`` steps if that is given.
    Past the first level only references to events that reference others can match, so the rest are left out of its joins.
    """
    refs = cut(tags.where("kind IN (1, 1111) AND tag_key = 'e'").select(F.col("tag_value").alias("to"), F.col("event_id").alias("from_id")).distinct(), "references")
    seen = roots.select(F.col("id").alias("root_id"), F.col("id").alias("event_id"), F.lit(0).alias("level"))
    front = seen
    for level in count(1) if levels is None else range(1, levels + 1):
        if level == 2:
            refs = cut(refs.join(refs.select(F.col("from_id").alias("to")).distinct(), "to", "left_semi"), "inner-references")
        nxt = front.select("root_id", F.col("event_id").alias("to")).join(refs, "to").select("root_id", F.col("from_id").alias("event_id")).distinct()
        front = cut(nxt.join(seen.select("root_id", "event_id"), ["root_id", "event_id"], "left_anti").withColumn("level", F.lit(level)), "thread-level")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen.where("level > 0")


def forest(links: DataFrame) -> tuple[DataFrame, int]:
    """((id, depth, descendants) of every node of (id, up) links with one up each, rounds taken).

    Pointers double: after round k a node points 2^k links up, and its size counts the nodes less than 2^k links below,
    itself included. A round adds to each node the sizes of those that point at it, exactly 2^k below, and lets pointers
    jump by their target's. So a chain of n takes about log2(n) rounds, each of one row a node, summed before it is
    shuffled; no (node, ancestor) pairs. On a cycle and below one, each other node counts once (:func:`cyclic`).
    """
    up, links = F.col("up"), links.dropDuplicates(["id"])
    nodes = links.select("id").union(links.select(up.alias("id"))).distinct()
    now = cut(nodes.join(links, "id", "left").select("id", "up", up.isNotNull().cast("long").alias("depth"), F.lit(1).cast("long").alias("size")), "forest")
    most, rounds = now.count().bit_length() + 1, 0
    while rounds < most and now.where(up.isNotNull()).limit(1).count():
        got = now.where(up.isNotNull()).groupBy(up.alias("id")).agg(F.sum("size").alias("got"))
        above = now.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        jumped = now.where(up.isNotNull()).join(above, "up").select("id", "far", F.col("more"))
        nxt = now.join(jumped, "id", "left").join(got, "id", "left")
        nxt = cut(nxt.select("id", F.col("far").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("got", F.lit(0))).alias("size")), "forest")
        discard(now)
        now, rounds = nxt, rounds + 1
    ended = now.where(up.isNull()).select("id", "depth", (F.col("size") - 1).alias("descendants"))
    endless = now.where(up.isNotNull()).select("id", "up")
    if not endless.limit(1).count():
        return ended, rounds
    return ended.unionByName(cyclic(links, endless, rounds)), rounds


def cyclic(links: DataFrame, endless: DataFrame, rounds: int) -> DataFrame:
    """(id, depth, descendants) of nodes that come to no root, from pointers (id, up) so far up that they end on the cycles.

    On a cycle of n, a node has the n - 1 others above it, and below it all that come to the cycle; a node beside it has
    its way to the cycle and then the cycle above it. Cycles are told apart by their smallest id, which doubles like the rest.
    """
    on = cut(endless.select(F.col("up").alias("id")).distinct().join(links, "id").select("id", "up", F.col("id").alias("least")), "cycles")
    for _ in range(rounds):
        far = on.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("least").alias("other"))
        nxt = cut(on.join(far, "up").select("id", F.col("far").alias("up"), F.least("least", "other").alias("least")), "cycles")
        discard(on)
        on = nxt
    label = on.select("id", "least")
    length = label.groupBy("least").agg(F.count("*").alias("n"))
    whole = endless.join(label.select(F.col("id").alias("up"), "least"), "up").groupBy("least").agg(F.count("*").alias("all"))
    mine = label.join(length, "least").join(whole, "least").select("id", "n", "all")
    beside = links.join(endless.select("id"), "id", "left_semi").join(label.select("id"), "id", "left_anti")
    hanging, _ = forest(beside)  # its roots are on the cycles
    way = hanging.join(label.select("id"), "id", "left_anti").select("id", F.col("depth").alias("way"), F.col("descendants").alias("below"))
    above = way.join(endless, "id").join(label.select(F.col("id").alias("up"), "least"), "up").join(length, "least")
    return mine.select("id", (F.col("n") - 1).alias("depth"), (F.col("all") - 1).alias("descendants")).unionByName(
        above.select("id", (F.col("way") + F.col("n") - 1).alias("depth"), F.col("below").alias("descendants")))


def thread_tree(edges: DataFrame, likes: DataFrame) -> DataFrame:
    """(node, depth, children, descendants, likes) of every node with a parent or a child."""
    links = edges.select(F.col("child_id").alias("id"), F.col("parent_id").alias("up"))
    tree, _ = forest(links)
    children = links.groupBy(F.col("up").alias("node")).agg(F.count_distinct("id").alias("children"))
    out = tree.withColumnRenamed("id", "node").join(children, "node", "left").join(likes.select(F.col("target_event_id").alias("node"), "likes"), "node", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("node", zero("depth"), zero("children"), zero("descendants"), zero("likes"))


def ranked_replies(edges: DataFrame, counter: DataFrame, by: str, *more: str) -> DataFrame:
    """(parent_id, child_id, score, position): direct replies by a counter of theirs; those without stay, with 0. ``more``:
    ``created_at``, if that is to come along.

    All replies are range-partitioned in their order and numbered within a partition; a parent's earlier
    partitions add their counts. So no task sorts all replies of a hot parent.
    """
    c = counter.select(F.col("target_event_id").alias("child_id"), F.col(by).alias("score"))
    j = edges.join(c, "child_id", "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("long"))
    order = [F.desc("score"), F.desc("created_at"), F.desc("child_id")]
    j = j.select("parent_id", "child_id", "score", "created_at").repartitionByRange(F.asc("parent_id"), *order)
    j = cut(j.withColumn("part", F.spark_partition_id()), "replies-in-order")
    before = Window.partitionBy("parent_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = j.groupBy("parent_id", "part").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    j = ranked(j, ["parent_id", "part"], order, "place").join(earlier, ["parent_id", "part"])
    return j.select("parent_id", "child_id", "score", (F.col("place") + F.col("earlier")).cast("int").alias("position"), *more)


def _bytes(df: DataFrame, key: str) -> Column:
    """A key column as bytes; one that is packed already as it is."""
    return F.col(key) if dict(df.dtypes)[key] == "binary" else packed(F.col(key))


def best_followed_reply(viewers: DataFrame | None, edges: DataFrame, follows: DataFrame, likes: DataFrame) -> DataFrame:
    """(viewer, parent_id, child_id): of the replies by people the viewer follows, the most liked, then newest. ``viewers``: (viewer, parent_id), or None for every viewer at every parent.

    A reply meets its author's followers once, so that rows grow with replies times followers, not with a thread's replies
    times its viewers; those rows are shuffled once, with 64-digit keys in 32 bytes. Keys may come packed; the viewer and the parent are given as texts.
    """
    f = follows.select(_bytes(follows, "follower").alias("viewer"), F.col("followed").alias("child_pubkey"))
    scored = edges.join(likes.select(F.col("target_event_id").alias("child_id"), "likes"), "child_id", "left")
    j = scored.select(_bytes(edges, "parent_id").alias("parent_id"), "child_id", "child_pubkey", "created_at", F.coalesce("likes", F.lit(0)).alias("likes"))
    if viewers is not None:
        asked = viewers.select(_bytes(viewers, "viewer").alias("viewer"), _bytes(viewers, "parent_id").alias("parent_id")).distinct()
        j = j.join(asked, "parent_id").join(f, ["viewer", "child_pubkey"], "left_semi")
    else:
        j = j.join(f, "child_pubkey")
    j = j.select("viewer", "parent_id", "child_id", "created_at", "likes").repartition("viewer", "parent_id")
    best = latest(j, ["viewer", "parent_id"], [F.desc("likes"), F.desc("created_at"), F.desc("child_id")])
    return best.select(unpacked(F.col("viewer")).alias("viewer"), unpacked(F.col("parent_id")).alias("parent_id"), "child_id")


def thread_order(threads: DataFrame, chain: DataFrame, followed: DataFrame, ranked: DataFrame, ranked_limit: int = 10) -> DataFrame:
    """(root_id, event_id, position): the author's chain, a followed reply, the best ranked, then direct replies by recency, then the rest of the thread.

    ``threads`` (root_id, event_id, place) bounds what may appear; an event takes its first tier.
    """
    tier = lambda df, n, at: df.select("root_id", "event_id", F.lit(n).alias("tier"), at.cast("long").alias("at"))
    parts = tier(chain, 1, F.col("step")).unionByName(tier(followed, 2, F.lit(0))).unionByName(tier(ranked.where(F.col("position") <= ranked_limit), 3, F.col("position")))
    parts = parts.unionByName(tier(ranked, 4, F.col("recency"))).unionByName(tier(threads, 5, F.col("place")))
    first = parts.groupBy("root_id", "event_id").agg(F.min(F.struct("tier", "at")).alias("first")).join(threads.select("root_id", "event_id"), ["root_id", "event_id"], "left_semi")
    return top_per_key(first, ["root_id"], [F.asc("first"), F.asc("event_id")], 1 << 30, name="position").select("root_id", "event_id", "position")


def same_author(events: DataFrame, targets: DataFrame, kinds: tuple[int, ...], n: int) -> DataFrame:
    """(pubkey, id, rank): the newest events of the targets' authors."""
    own = events.where(F.col("kind").isin(*kinds)).join(targets.select("pubkey").distinct(), "pubkey", "left_semi")
    return top_per_key(own, ["pubkey"], [F.desc("created_at"), F.desc("id")], n, name="rank").select("pubkey", "id", "rank")


def dependent_keys(events: DataFrame, tags: DataFrame) -> DataFrame:
    """(what, key): engagement targets, authors and named people of a set of events."""
    e = tags.where("tag_key IN ('e', 'q') AND octet_length(tag_value) = 64").select(F.lit("event").alias("what"), F.col("tag_value").alias("key"))
    p = tags.where("tag_key = 'p' AND octet_length(tag_value) = 64").select(F.lit("pubkey").alias("what"), F.col("tag_value").alias("key"))
    return e.unionByName(p).unionByName(events.select(F.lit("pubkey").alias("what"), F.col("pubkey").alias("key"))).distinct()
