"""Near-duplicate detection: one-permutation MinHash, optimal densification, bands, star candidates.

A text's set holds the 64-bit hashes of its distinct word shingles. Rows with equal sets are one class
from the start. A class's set, sorted, gives its signature: the hash's top bits pick one of the bins,
the first hash of a bin is its minimum, and empty bins borrow from hashed choices among the others
(optimal densification). Classes that share a band of bins meet in a bucket; each bucket links its
members to one centre only, so candidates grow with members, not pairs. Candidates are confirmed on full
sets by exact integer comparison. Where a bucket still holds several components, its members outside the
largest one are compared with the others, unless sizes or the number of shingles that occur in no other
set of such buckets rule every link out. That comparison runs in cells of bounded size inside tasks, and
only pairs of components that it joins leave a cell. So no pair of a bucket is lost, pairs within a
component need no comparison, and links grow with members.

With 128 bins in 32 bands of 4, a pair at similarity 0.8 shares no bucket with probability 5e-8.

Defined cases: null and empty texts, and texts without words, have an empty set and link to nothing;
rows that repeat a doc_id count as one document with several texts, the smallest id of a group is its
component; rows with a null doc_id link to nothing and keep a null component; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.llm.arrow_text import blocks, list_array
from socialspark.llm.components import components
from socialspark.sources.scratch import cut, discard

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
BINS, BANDS = 128, 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get("up", ())):
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document) of the distinct word shingles, sorted by document and hash."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = ~space[edge]
    begin = np.flatnonzero(begins)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stops = np.zeros(len(data) + 1, bool)
    stops[:-1] = space
    stops[offsets] = True
    stop = np.flatnonzero(stops)
    end = stop[np.searchsorted(stop, begin, side="right")]
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * up[: len(data)], out=sums[1:], dtype=np.uint64)
    word = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    doc = np.searchsorted(offsets, begin, side="right") - 1
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)[:n_docs]
    acc = np.zeros(max(len(word) - k + 1, 0), np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + word[j : len(word) - k + 1 + j]
    whole = doc[: len(acc)] == doc[k - 1 :] if len(acc) else np.zeros(0, bool)
    hashes, owner = mix64(acc[whole]), doc[: len(acc)][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):  # fewer words than a shingle: the whole sequence as one
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        tail = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            there = count[short] > j
            tail[there] = tail[there] * np.uint64(0x9FB21C651E98DF25) + word[first[short[there]] + j]
        hashes = np.concatenate([hashes, mix64(tail ^ (count[short].astype(np.uint64) << np.uint64(56)))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _donors(bins: int, tries: int) -> np.ndarray:
    i, a = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(1, tries + 1, dtype=np.uint64), indexing="ij")
    return (mix64(i * np.uint64(0x100000001B3) + a * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(bins)).astype(np.int64)


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """n x bins minima, densified; rows of empty sets stay at the largest value."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((n, bins), none, np.uint64)
    bin_of = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (bin_of[1:] != bin_of[:-1])
    sig[owner[first], bin_of[first]] = hashes[first]
    filled = sig != none
    some = filled.any(1)
    row, col = np.nonzero(~filled & some[:, None])
    donors, attempt, base = _donors(bins, 256), 0, sig.copy()
    while len(row):
        from_ = donors[col, attempt % 256] if attempt < 256 else (col + attempt) % bins
        ok = filled[row, from_]
        sig[row[ok], col[ok]] = base[row[ok], from_[ok]]
        row, col, attempt = row[~ok], col[~ok], attempt + 1
    return sig


def _bands(sig: np.ndarray, bands: int) -> np.ndarray:
    n, bins = sig.shape
    width = bins // bands
    key = np.zeros((n, bands), np.uint64)
    for j in range(width):
        key = mix64(key * np.uint64(31) + sig.reshape(n, bands, width)[:, :, j])
    return mix64(key + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)


def _set_keys(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes | None]]:
    bounds = np.searchsorted(owner, np.arange(n + 1))
    raw = hashes.tobytes()
    return np.diff(bounds), [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def sketch(docs: DataFrame, k: int, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes; null if empty), bands (one key each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "text", 1 << 20):
                n = end - first
                hashes, owner = shingle_sets(data, offsets, k)
                sizes, keys = _set_keys(hashes, owner, n)
                key = _bands(signatures(hashes, owner, n, bins), bands)[sizes > 0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(sizes.astype(np.int64)), pa.array(keys, pa.binary()), list_array(pa.array(key.ravel()), np.where(sizes > 0, bands, 0))],
                    names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _node(rep: str, set_key: str) -> Column:
    """A class's name: its smallest doc_id as 8 bytes that sort like the number, then the set's key."""
    return F.unhex(F.concat(F.lpad(F.hex(F.col(rep).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.hex(set_key)))


def _rep(node: str) -> Column:
    """The doc_id in a node's name."""
    return (F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, hashes): the sorted 64-bit hashes of each node's set, once.

    Texts move once, by doc_id; a doc_id may come with several texts, of which the one with the node's set counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "text", 1 << 20):
                n = end - first
                hashes, owner = shingle_sets(data, offsets, k)
                _, keys = _set_keys(hashes, owner, n)
                want = batch.column("node").slice(first, n)
                keep = pa.array([x == y[8:] for x, y in zip(keys, want.to_pylist(), strict=True)], pa.bool_())
                bounds, raw = (np.searchsorted(owner, np.arange(n + 1)) * 8).tolist(), hashes.tobytes()
                held = pa.array([raw[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([want, held], names=["node", "hashes"]).filter(keep)

    wanted = nodes.select("node", _rep("node").alias("rep"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).join(wanted, "rep").select("node", "text")
    return texts.mapInArrow(run, "node binary, hashes binary").dropDuplicates(["node"])


def _linked(both: np.ndarray, x: np.ndarray | int, y: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * both >= percent * (x + y - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a").select("a", "b", "hashes_a", "hashes_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(bool(_linked(both, len(p), len(q), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return two.mapInArrow(run, "a binary, b binary")


def _shared_counts(sets: DataFrame) -> DataFrame:
    """(node, shared): how many of a set's shingles occur in another of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("hashes")]
            if held:
                owner = pa.array(np.repeat(np.arange(len(held)), list(map(len, held))))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(owner), pa.array(np.concatenate(held))], names=["node", "h"])

    shingles = sets.mapInArrow(run, "node binary, h long")
    common = cut(shingles.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared-shingles")
    out = cut(shingles.join(common, "h", "left_semi").groupBy("node").agg(F.count("*").alias("shared")), "shared-counts")
    discard(common)
    return out


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """len(x) x len(y): the intersection sizes of two lists of sorted sets, by products of 0/1 slices over the common hashes."""
    all_x, all_y = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(np.unique(all_x), np.unique(all_y), assume_unique=True)
    out = np.zeros((len(x), len(y)), np.float64)
    sides = []
    for side, flat in ((x, all_x), (y, all_y)):
        owner = np.repeat(np.arange(len(side)), list(map(len, side)))
        place = np.searchsorted(both, flat)
        there = place < len(both)
        there[there] = both[place[there]] == flat[there]
        order = np.argsort(place[there], kind="stable")
        sides.append((owner[there][order], place[there][order], len(side)))
    for at in range(0, len(both), 4096):
        grids = []
        for owner, place, n in sides:
            lo, hi = np.searchsorted(place, (at, at + 4096))
            g = np.zeros((n, min(4096, len(both) - at)), np.float32)
            g[owner[lo:hi], place[lo:hi] - at] = 1
            grids.append(g)
        out += grids[0] @ grids[1].T
    return out


def _merges(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels that a link between two of ``members`` joins.

    ``members``: (band, node, label, main, outside, parts_out, parts_main, hashes). A band's members outside its
    largest component, and those in it, are dealt to parts of a bounded size. Each cell, a pair of parts
    of which one is outside, is one group of rows; its sets are compared exactly there, and only the label
    pairs that a union-find of the cell has not joined before leave it: fewer than the cell has members.
    """
    part = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("parts_out")).otherwise(F.col("parts_main"))) + F.when(F.col("outside"), 0).otherwise(F.col("parts_out"))
    last = F.when(F.col("outside"), F.col("parts_out") + F.col("parts_main")).otherwise(F.col("parts_out")) - 1
    rows = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    rows = rows.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("first"), "label", "hashes")

    def compare(group: pa.Table) -> pa.Table:
        labels = group.column("label").to_pylist()
        a: list[bytes] = []
        b: list[bytes] = []
        if len(set(labels)) > 1:
            held = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
            first = np.array(group.column("first").to_pylist())
            x = np.flatnonzero(first)
            y = x if group.column("i")[0] == group.column("j")[0] else np.flatnonzero(~first)
            if len(x) and len(y):
                n = np.array(list(map(len, held)))
                names, of = np.unique(np.array(labels, object), return_inverse=True)
                p, q = np.nonzero(_linked(common_counts([held[k] for k in x], [held[k] for k in y]), n[x][:, None], n[y][None, :], percent))
                p, q = of[x[p]], of[y[q]]
                pairs = np.unique(np.minimum(p, q) * len(names) + np.maximum(p, q))
                up = list(range(len(names)))

                def top(v: int) -> int:
                    while up[v] != v:
                        up[v] = up[up[v]]
                        v = up[v]
                    return v

                for pair in pairs.tolist():
                    u, v = top(pair // len(names)), top(pair % len(names))
                    if u != v:
                        up[max(u, v)] = min(u, v)
                        a.append(names[pair // len(names)])
                        b.append(names[pair % len(names)])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("band", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, bins: int = BINS, bands: int = BANDS, part_shingles: int = 1 << 16, part_sets: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    ``part_shingles`` and ``part_sets`` bound (on average) the parts in which leftover members of a bucket are compared.
    """
    rows = cut(sketch(docs, k, bins, bands), "sketches")
    linkable = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.select("set_key", _node("rep", "set_key").alias("node"), "n", "bands"), "classes")
    members = classes.select("node", "n", F.explode("bands").alias("band"))
    # A centre for each bucket, by a hash of its own, so that one odd member is not the centre of many buckets.
    buckets = members.groupBy("band").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node", "band").alias("turn"), "node", "n")).alias("c")).where("m > 1")
    buckets = cut(buckets.select("band", F.col("c.node").alias("centre"), F.col("c.n").alias("n_c")), "buckets")
    crowded = cut(members.join(buckets, "band"), "bucket-members")
    discard(buckets)
    near = 100 * F.least("n", "n_c") >= percent * F.greatest("n", "n_c")  # sizes further apart can't reach the similarity
    star = crowded.where((F.col("centre") != F.col("node")) & near)
    pairs = star.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    sets = cut(_sets(docs, crowded.select("node").distinct(), k), "bucket-sets")
    links = cut(_confirm(pairs, sets, percent), "links")
    labels = components(links)
    discard(links)
    merges = _leftover(crowded.select("band", "node", "n"), labels, sets, percent, part_shingles, part_sets)
    discard(crowded)
    discard(sets)
    merged = components(merges)
    discard(merges)
    named = classes.select("set_key", "node").join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("set_key", F.coalesce("label", "node").alias("was"))
    named = named.join(merged, named["was"] == merged["node"], "left").select("set_key", _rep(F.coalesce("label", "was")).alias("component_id"))
    named = cut(named, "class-components")
    for done in (classes, labels, merged):
        discard(done)
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _leftover(crowded: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, part_shingles: int, part_sets: int) -> DataFrame:
    """(a, b): label pairs joined by links within buckets that still hold several components."""
    placed = crowded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = cut(placed, "placed")
    per = placed.groupBy("band", "label").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    parted = per.groupBy("band").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("parts"), F.min("least").alias("least")).where("parts > 1").drop("parts")
    parted = cut(parted, "parted-buckets")
    open_ = cut(placed.join(parted, "band"), "open-members")
    discard(placed)
    discard(parted)
    held = sets.join(open_.select("node").distinct(), "node", "left_semi")
    shared = _shared_counts(held)
    # A link needs an intersection of percent / (100 + percent) of both sizes; no more of a set than the shingles it shares can be in one.
    fits = (100 + percent) * F.coalesce("shared", F.lit(0)) >= percent * (F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100)))
    able = open_.join(shared, "node", "left").where(fits).select("band", "node", "n", "label", (F.col("label") != F.col("main")).alias("outside"))
    able = cut(able, "able-members")
    discard(open_)
    discard(shared)
    parts = lambda own: F.ceil(F.greatest(F.sum(F.when(own, F.col("n"))) / part_shingles, F.count_if(own) / part_sets))
    busy = able.groupBy("band").agg(F.count("*").alias("m"), parts(F.col("outside")).alias("parts_out"), F.coalesce(parts(~F.col("outside")), F.lit(0)).alias("parts_main"))
    busy = cut(busy.where("parts_out > 0 AND m > 1"), "busy-buckets")
    merges = cut(_merges(able.join(busy, "band").join(sets, "node"), percent), "merges")
    discard(able)
    discard(busy)
    return merges


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns (repeated rows of the kept id included)."""
    kept = near_components(docs, k, percent).where("kept").select("doc_id").distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(w[i : i + least(4, len(w)) - 1]) AS g
  FROM w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
u AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      WHERE a.g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) GROUP BY ALL),
e AS (SELECT a, b FROM u JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
c AS (
  WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
