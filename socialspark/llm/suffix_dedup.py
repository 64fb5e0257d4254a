"""Substring deduplication by prefix-free parsing.

A string of ``length`` bytes that starts at two or more places is removed wherever it stands; strings of
``least`` bytes (some fifty words) that do are counted besides. The corpus order of suffixes is needed only
down to those lengths, and only where something repeats:

1. Triggers. A rolling hash of 16 bytes runs over each text. The trigger of a start i is the smallest
   hash (the last of equals) among the ``reach`` positions from i on. It depends on bytes of the string
   at i only, so equal strings have equal triggers at equal distance. Triggers part a text to phrases.
2. Parse. A trigger is named by the hash of the context from it that every string over it must hold.
   Names that occur once cannot be in a repeated string; this drops nearly all of an ordinary corpus
   before any text moves. Texts that are equal as a whole are one text with a count.
3. Dictionary. For a phrase under a repeated name, the phrase with the ``length`` bytes after it decides
   all strings that start in it. Phrases that occur twice in full are repeated as a whole.
4. Order. Where one name has several different phrases, those dictionary entries meet (whole names in one
   group) and the suffixes that start in them are sorted by prefix doubling over their bytes, no hashes:
   equal ranks at ``length`` bytes are equal strings. A name with very many phrases is dealt to parts; the
   strings that a part leaves single, and one of each that it does not, are then matched between parts by
   128-bit hashes.

Counts go through partial aggregation and joins have plain tables on both sides, so that a passage in a
third of all texts spreads; no group is gathered in a task beyond the size stated.

Defined cases: null texts are empty; texts shorter than ``least`` lose nothing; rows that repeat a
text, with the same doc_id or another, are further places of its strings, so all lose them; null doc_ids
pass through; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.llm.arrow_text import blocks, list_array
from socialspark.llm.minhash_dedup import _power, mix64
from socialspark.sources.scratch import cut, discard

ROLL = 16
_rng = np.random.default_rng(11)
_TABLES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
#: Bytes per numpy step; a longer text makes a step of its own.
STEP = 1 << 20
#: Positions of a step take so many bits beside a rolling hash, at any size.
_PLACE = np.uint64(32)


class Hashes:
    """Prefix sums that give the hash of any substring of a block."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * up[: len(data)], out=self.sums[1:], dtype=np.uint64)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def phrases(data: np.ndarray, offsets: np.ndarray, least: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, last start, trigger, name) of each run of starts with one trigger."""
    reach = 2 * least // 5
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    size = np.diff(offsets)
    if not (size >= least).any():
        return none
    n = len(data) - ROLL + 1
    at = np.arange(n, dtype=np.int64)
    key = ((hashes.of(at, at + ROLL) >> _PLACE) << _PLACE) | (np.uint64(n - 1) - at.astype(np.uint64))
    span = 1
    while 2 * span <= reach:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if span < reach:
        key = np.minimum(key[: len(key) - (reach - span)], key[reach - span :])
    trigger = n - 1 - (key & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    starts = np.maximum(size - least + 1, 0)
    doc = np.repeat(np.arange(len(size)), starts)
    i = np.arange(int(starts.sum())) - np.repeat(np.concatenate([[0], np.cumsum(starts)[:-1]]), starts) + np.repeat(offsets[:-1], starts)
    own = trigger[i]
    new = np.ones(len(i), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    a = own[first]
    return doc[first], i[first], i[last], a, hashes.of(a, a + (least - reach + 1))


def _parse(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), sha, n_bytes, names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "text", STEP):
                raw, n = data.tobytes(), end - first
                sha = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                doc, _, _, _, names = phrases(data, offsets, least, Hashes(data, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), batch.column("mark").slice(first, n), pa.array(sha, pa.binary()), pa.array(np.diff(offsets)), list_array(pa.array(names.astype(np.int64)), np.bincount(doc, minlength=n)[:n])],
                    names=["doc_id", "mark", "sha", "n_bytes", "names"])

    return _texts(docs).mapInArrow(run, "doc_id long, mark long, sha binary, n_bytes long, names array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("mark"))


def _dictionary(texts: DataFrame, length: int, least: int) -> DataFrame:
    """Flagged phrases: name, phrase (identity of it and the bytes after it), tid, place, first, last, far (the last start that has ``length`` bytes), copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "text", STEP):
                h, g = Hashes(data, 0), Hashes(data, 1)
                doc, lo, hi, a, names = phrases(data, offsets, least, h)
                row, place, _ = _flagged(batch, first, end, doc)
                lo_, hi_, a_, stop = lo[row], hi[row], a[row], offsets[doc[row] + 1]
                to = np.minimum(hi_ + length, stop)
                ids = np.stack([h.of(lo_, to), g.of(lo_, to), ((a_ - lo_).astype(np.uint64) << np.uint64(32)) | (hi_ - lo_).astype(np.uint64)], 1)
                raw, base = ids.tobytes(), offsets[doc[row]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[row].astype(np.int64)), pa.array([raw[24 * k : 24 * k + 24] for k in range(len(row))], pa.binary()), batch.column("tid").take(pa.array(doc[row] + first)),
                     pa.array(place), pa.array(lo_ - base), pa.array(hi_ - base), pa.array(np.minimum(hi_, stop - length) - base), batch.column("copies").take(pa.array(doc[row] + first))],
                    names=["name", "phrase", "tid", "place", "first", "last", "far", "copies"])

    return texts.mapInArrow(run, "name long, phrase binary, tid long, place int, first long, last long, far long, copies long")


def _flagged(batch: pa.RecordBatch, first: int, end: int, doc: np.ndarray, more: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the block's phrase arrays that ``places`` names, their place in their document, and the values of the list ``more``."""
    at = np.searchsorted(doc, np.arange(end - first))
    col = batch.column("places").slice(first, end - first)
    places = col.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    own = np.repeat(np.arange(end - first), np.diff(col.offsets.to_numpy()))
    there = places < np.bincount(doc, minlength=end - first)[own]  # another text with the same mark may have more
    others = batch.column(more).slice(first, end - first).flatten().to_numpy(zero_copy_only=False)[there] if more else places[:0]
    return (at[own] + places)[there], places[there], others


def _entries(texts: DataFrame, length: int, least: int) -> DataFrame:
    """One row per dictionary entry to sort: name, parts (of its name), tid, first, n (starts), piece (the bytes that decide them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "text", STEP):
                doc, lo, hi, _, names = phrases(data, offsets, least, Hashes(data, 0))
                row, _, parts = _flagged(batch, first, end, doc, "parts")
                raw, to = data.tobytes(), np.minimum(hi[row] + length, offsets[doc[row] + 1])
                pieces = [raw[x:y] for x, y in zip(lo[row].tolist(), to.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[row].astype(np.int64)), pa.array(parts.astype(np.int64)), batch.column("tid").take(pa.array(doc[row] + first)), pa.array(lo[row] - offsets[doc[row]]), pa.array((hi - lo + 1)[row]), pa.array(pieces, pa.binary())],
                    names=["name", "parts", "tid", "first", "n", "piece"])

    return texts.mapInArrow(run, "name long, parts long, tid long, first long, n long, piece binary")


def _ranks(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each length, numbers that order the strings of that many bytes at every place; past the end count as zero bytes."""
    need, k, out = sorted(lengths), 8, {}
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for b in range(8):
        words = (words << np.uint64(8)) | padded[b : b + len(data)].astype(np.uint64)
    rank = np.unique(words, return_inverse=True)[1]

    def paired(step: int) -> np.ndarray:
        after = np.zeros(len(rank), np.int64)
        after[: max(len(rank) - step, 0)] = rank[step:] + 1
        return np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1]

    while need:
        if need[0] <= 2 * k:
            out[need[0]] = paired(need[0] - k)
            need = need[1:]
        else:
            rank, k = paired(k), 2 * k
    return out


def repeated_starts(pieces: list[bytes], n: np.ndarray, lengths: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (piece, start, again, leader) of the starts whose string lies within its piece; ``again``: it occurs at another of them, ``leader``: it is the first of such equals."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array(list(map(len, pieces)), np.int64)
    base = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(pieces)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = {}
    for length, rank in _ranks(data, lengths).items():
        ok = start + length <= size[piece]
        p, i = piece[ok], start[ok]
        _, first, of, count = np.unique(rank[base[p] + i], return_index=True, return_inverse=True, return_counts=True)
        leader = np.zeros(len(p), bool)
        leader[first] = True
        again = count[of] > 1
        out[length] = (p, i, again, leader & again)
    return out


def _order(entries: DataFrame, length: int, least: int, buckets: int, part_entries: int) -> DataFrame:
    """tid, level, firsts, lasts (runs of repeated starts); for names in parts also the strings a part leaves single (weight 1) and one of each other (weight 2), by m1 and m2."""

    def sort(group: pa.Table) -> pa.Table:
        cols: dict[str, list] = {k: [] for k in ("tid", "level", "firsts", "lasts", "m1", "m2", "weight")}

        def add(**row) -> None:
            for k, v in cols.items():
                v.append(row.get(k))

        pieces, n = group.column("piece").to_pylist(), group.column("n").to_numpy()
        tid, begin, parts = group.column("tid").to_pylist(), group.column("first").to_numpy(), group.column("parts").to_numpy()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array(list(map(len, pieces)), np.int64)
        base = np.cumsum(size) - size
        marks = (Hashes(data, 0), Hashes(data, 1)) if (parts > 1).any() else None
        for level, (p, i, again, leader) in repeated_starts(pieces, n, (least, length)).items():
            at = np.flatnonzero(again)
            if len(at):  # runs of neighbouring starts, by piece
                cut_ = np.flatnonzero((p[at][1:] != p[at][:-1]) | (i[at][1:] != i[at][:-1] + 1)) + 1
                lo, hi = np.append(0, cut_), np.append(cut_, len(at)) - 1
                own, firsts, lasts = p[at[lo]], i[at[lo]] + begin[p[at[lo]]], i[at[hi]] + begin[p[at[lo]]]
                edge = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    add(tid=tid[own[x]], level=level, firsts=firsts[x:y].tolist(), lasts=lasts[x:y].tolist())
            if marks:
                more = np.flatnonzero((parts[p] > 1) & (~again | leader))
                where = base[p[more]] + i[more]
                m1, m2 = (m.of(where, where + level).astype(np.int64).tolist() for m in marks)
                for x, u, v in zip(more.tolist(), m1, m2, strict=True):
                    at_ = [int(i[x] + begin[p[x]])]
                    add(tid=tid[p[x]], level=level, firsts=at_, lasts=at_, m1=u, m2=v, weight=2 if again[x] else 1)
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(cols.items(), kinds, strict=True)})

    part = F.pmod(F.xxhash64("tid", "first"), F.col("parts"))
    rows = entries.withColumn("bucket", F.pmod(F.xxhash64("name", part), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(sort, "tid long, level int, firsts array<long>, lasts array<long>, m1 long, m2 long, weight int")


def _spans(firsts: list[int], lasts: list[int], length: int) -> tuple[list[int], list[int]]:
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted(zip(firsts, lasts, strict=True)):
        if begins and a <= ends[-1]:
            ends[-1] = max(ends[-1], b + length)
        else:
            begins.append(a)
            ends.append(b + length)
    return begins, ends


def _removals(texts: DataFrame, length: int, least: int) -> DataFrame:
    """sha, n_removed, n_spans, n_repeated, kept_sha256, begins, ends from runs of repeated starts (firsts, lasts) of either length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k in range(batch.num_rows):
                raw = (batch.column("text")[k].as_py() or "").encode()
                near_b, near_e = _spans(batch.column("near_firsts")[k].as_py(), batch.column("near_lasts")[k].as_py(), least)
                begins, ends = _spans(batch.column("firsts")[k].as_py(), batch.column("lasts")[k].as_py(), length)
                kept, at = hashlib.sha256(), 0
                for a, b in zip(begins, ends, strict=True):
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                for x, v in zip(out, (sum(ends) - sum(begins), len(begins), sum(near_e) - sum(near_b), kept.hexdigest(), begins, ends), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sha"), *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.list_(pa.int64()))],
                names=["sha", "n_removed", "n_spans", "n_repeated", "kept_sha256", "begins", "ends"])

    return texts.mapInArrow(run, "sha binary, n_removed long, n_spans long, n_repeated long, kept_sha256 string, begins array<long>, ends array<long>")


def repeated_spans(docs: DataFrame, length: int = 400, least: int = 280, part_entries: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, begins, ends.

    ``begins`` and ``ends`` are the byte ranges removed; ``n_repeated`` is the number of bytes covered by strings of
    ``least`` bytes that start at two or more places. ``part_entries`` bounds the phrases of one name that meet in a group.
    """
    if not 5 * ROLL // 2 <= least <= length:
        raise ValueError("least must be at least 40 bytes and at most length")
    parsed = cut(_parse(docs, least), "parsed")
    whole = cut(parsed.groupBy("sha").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.count("*").alias("copies"), F.first("names").alias("names")), "whole-texts")
    rows = cut(parsed.select("doc_id", "sha", "n_bytes"), "rows")
    discard(parsed)  # the names live on in ``whole``
    # Texts go by their 64-bit mark here; where two share one, each gets the other's places as well, which only adds work.
    named = whole.where("size(names) > 0").select(F.col("rep.mark").alias("mark"), "copies", F.posexplode("names").alias("place", "name"))
    repeated = cut(named.groupBy("name").agg(F.sum("copies").alias("n")).where("n > 1").select(F.col("name").alias("again")), "repeated-names")
    places = named.select("mark", "place", "name").join(repeated, F.col("name") == F.col("again"), "left_semi").groupBy("mark").agg(F.array_sort(F.collect_set("place")).alias("places"))  # of one text each
    wanted = places.join(whole.select("sha", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.mark").alias("mark")), "mark").withColumnRenamed("mark", "rep_mark")
    t = _texts(docs)
    # The one movement of texts: one of each, and only those with a repeated name go on, under a short id.
    texts = t.join(wanted, t["doc_id"].eqNullSafe(F.col("rep_id")) & (t["mark"] == F.col("rep_mark"))).where(F.unhex(F.sha2("text", 256)) == F.col("sha"))
    texts = cut(texts.dropDuplicates(["sha"]).select(F.monotonically_increasing_id().alias("tid"), "sha", "copies", "text", "places"), "repeated-texts")
    counts = cut(whole.select("sha", "copies"), "copies")
    discard(whole)
    discard(repeated)
    found = cut(_dictionary(texts, length, least), "phrases")
    kinds = cut(found.groupBy("name", "phrase").agg(F.sum("copies").alias("n"), F.min(F.struct("tid", "place")).alias("one")), "phrase-kinds")
    # Phrases repeated in full, and names with several phrases
    full = found.join(kinds.where("n > 1").select("name", "phrase"), ["name", "phrase"], "left_semi")
    near = F.struct(F.lit(least).alias("level"), F.col("last").alias("to"))
    full = full.select("tid", "first", F.explode(F.array(near, F.struct(F.lit(length).alias("level"), F.col("far").alias("to")))).alias("x")).where("x.to >= first")
    full = full.select("tid", F.col("x.level").alias("level"), F.array("first").alias("firsts"), F.array("x.to").alias("lasts"))
    mixed = cut(kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).where("kinds > 1 AND fewest = 1").select("name", "kinds"), "mixed-names")
    buckets = max(1, -(-(mixed.agg(F.sum("kinds")).first()[0] or 0) // part_entries))
    ask = kinds.join(mixed, "name").select("one.tid", F.struct("one.place", F.ceil(F.col("kinds") / part_entries).alias("parts")).alias("x"))
    ask = ask.groupBy("tid").agg(F.sort_array(F.collect_list("x")).alias("x")).select("tid", F.col("x.place").alias("places"), F.col("x.parts").alias("parts"))
    entries = _entries(texts.select("tid", "text").join(ask, "tid"), length, least)
    ordered = cut(_order(entries, length, least, buckets, part_entries), "ordered")
    discard(mixed)
    marked = ordered.where("weight IS NOT NULL")
    apart = cut(marked.groupBy("level", "m1", "m2").agg(F.sum("weight").alias("w")).where("w > 1").drop("w"), "met-between-parts")
    met = marked.where("weight = 1").join(apart, ["level", "m1", "m2"], "left_semi")
    runs = full.unionByName(ordered.where("weight IS NULL").select(*full.columns)).unionByName(met.select(*full.columns))
    of = lambda level, what: F.flatten(F.collect_list(F.when(F.col("level") == level, F.col(what))))
    runs = runs.groupBy("tid").agg(of(length, "firsts").alias("firsts"), of(length, "lasts").alias("lasts"), of(least, "firsts").alias("near_firsts"), of(least, "lasts").alias("near_lasts"))
    removed = cut(_removals(texts.select("tid", "sha", "text").join(runs, "tid"), length, least), "removals")
    for done in (found, kinds, ordered, apart, texts):
        discard(done)
    fate = cut(counts.join(removed, "sha", "left"), "fates")
    discard(removed)
    discard(counts)
    empty = hashlib.sha256(b"").hexdigest()
    out = rows.join(fate, "sha")
    all_ = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<long>")
    return out.select(
        "doc_id", "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & (F.col("n_bytes") >= least), F.col("n_bytes")).otherwise(F.coalesce("n_repeated", F.lit(0))).cast("long").alias("n_repeated"),
        F.when(all_, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("begins", none)).alias("begins"),
        F.when(all_, F.array(F.col("n_bytes"))).otherwise(F.coalesce("ends", none)).alias("ends"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
b AS (SELECT r, doc_id, lower(hex(encode(t))) AS x, strlen(t) AS n FROM d),
s AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM b, unnest(range(0, n - 399)) AS u(i) WHERE n >= 400),
dup AS (SELECT r, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
o AS (SELECT r, i, i - lag(i, 1, -1000000) OVER (PARTITION BY r ORDER BY i) > 400 AS new FROM dup),
g AS (SELECT r, i, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY i) AS k FROM o),
sp AS (SELECT r, k, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY r, k),
gap AS (SELECT r, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS z FROM sp
        UNION ALL SELECT r, max(z), NULL FROM sp GROUP BY r),
kept AS (SELECT gap.r, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(gap.z, n) - a)), '' ORDER BY a) AS x FROM gap JOIN b USING (r) GROUP BY gap.r),
tot AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM sp GROUP BY r),
s2 AS (SELECT r, i, md5(substr(x, 2 * i + 1, 560)) AS h FROM b, unnest(range(0, n - 279)) AS u(i) WHERE n >= 280),
dup2 AS (SELECT r, i FROM s2 WHERE h IN (SELECT h FROM s2 GROUP BY h HAVING count(*) > 1)),
rep AS (SELECT r, sum(least(280, step)) AS n_repeated FROM (SELECT r, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 280) AS step FROM dup2) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.x, b.x))) AS kept_sha256, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated
FROM b LEFT JOIN tot USING (r) LEFT JOIN kept USING (r) LEFT JOIN rep USING (r)
"""
