"""Benchmark decontamination with training suffix arrays.

Each task builds word-level suffix arrays over blocks of whole documents (its shards): words outside the
benchmark's vocabulary end a run, runs too short for any match are left out, and the suffixes of the
others are sorted by prefix doubling. Every test suffix is then found by binary search in every shard:
the range of shard suffixes that share its first ``window`` words gives all locations, and matches are
followed from there to their end, so each document's longest verbatim match is known. Documents with a
location are affected and can be removed. No document is shuffled or written again. Windows that occur in several
items are one entry with the set of those items, so that equal items and shared prompts cost no more than one. The
benchmark goes out in blocks of about ``block_bytes``; a task takes its documents some MB at a time and
loads the blocks one after another for them, so memory is bounded by a block of the benchmark and one block of documents.

Defined cases: null and empty texts have no words and are clean; items without words have no window;
rows that repeat a doc_id are judged one by one; null doc_ids pass through; a null item_id is the
name ''; an empty benchmark leaves every document clean; an empty table gives an empty result; other
columns of the inputs are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from socialspark.llm.arrow_text import blocks, list_array
from socialspark.sources.scratch import cut

#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; everything else parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Test suffixes searched at once, and words compared at once past the window.
BATCH, BATCH_WORDS = 1 << 16, 16


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class TestSet:
    """One block of the benchmark: vocabulary, words as ids (each item ended by 0) and every suffix's start, item, place and match length needed."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.vocab, self.names = window, {}, sorted({n for n, _ in items})
        rank, tokens, parts = {n: k for k, n in enumerate(self.names)}, [np.zeros(1, np.int64)], []
        at = 1
        for name, text in items:
            own = words(text.encode())
            tokens.append(np.array([*(self.vocab.setdefault(w, len(self.vocab) + 1) for w in own), 0], np.int64))
            parts.append((at, len(own), rank[name]))
            at += len(own) + 1
        self.tokens = np.concatenate([*tokens, np.zeros(window + BATCH_WORDS, np.int64)])
        first, size, item = (np.array(x, np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        self.item = np.repeat(item, size)
        self.word = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.start = np.repeat(first, size) + self.word
        self.left = np.repeat(size, size) - self.word
        self.need = np.repeat(np.minimum(size, window), size)
        self.longest = int(size.max(initial=0))

    def windows(self) -> TestSet:
        """Add the distinct windows (``rep``: a suffix that starts each; ``sets``: its set of items) and the order of the suffixes behind them.

        ``ranks[k]`` orders the places of ``tokens`` by their next 2**k words within the item, ``pairs[k]`` holds the pairs of ranks
        of half the words behind each rank; all suffixes that share a window are the range ``low`` to ``high`` of ``full``.
        """
        left, rank, step = np.zeros(len(self.tokens), np.int64), self.tokens, 1
        left[self.start] = self.left
        self.ranks, self.pairs = [rank.astype(np.int32)], [np.zeros(0, np.int64)]
        while step < self.longest:
            after = np.where(left[:-step] >= step, rank[step:], 0)
            pairs, rank = np.unique(rank * (int(rank.max()) + 1) + np.concatenate([after, np.zeros(step, np.int64)]), return_inverse=True)
            self.ranks.append(rank.astype(np.int32))
            self.pairs.append(pairs)
            step *= 2
        order = np.argsort(rank[self.start], kind="stable")
        full = order[self.left[order] >= self.window]
        new = np.ones(len(full), bool)
        if len(full):
            new[1:] = False
            for k in range(self.window):
                word = self.tokens[self.start[full] + k]
                new[1:] |= word[1:] != word[:-1]
        short = order[(self.left[order] == self.need[order]) & (self.need[order] < self.window)]  # whole items
        own = rank[self.start[short]]
        new = np.concatenate([new, np.ones(min(len(short), 1), bool), own[1:] != own[:-1]])
        members, bounds = np.concatenate([full, short]), np.append(np.flatnonzero(new), len(full) + len(short))
        self.full, self.rep = self.start[full], members[bounds[:-1]]
        self.low, self.high = np.minimum(bounds[:-1], len(full)), np.minimum(bounds[1:], len(full))
        pairs = np.unique((np.cumsum(new) - 1) * (len(self.names) + 1) + self.item[members])
        at = np.searchsorted(pairs // (len(self.names) + 1), np.arange(len(self.rep) + 1))
        known: dict[bytes, int] = {}
        items = (pairs % (len(self.names) + 1)).astype(np.int32)
        self.sets = np.array([known.setdefault(items[x:y].tobytes(), len(known)) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
        self.items = list(known)
        del self.item, self.word, self.left  # not sent: the search needs them no more
        return self

    def named(self, which: int) -> list[str]:
        """Names of a set of items, sorted."""
        return [self.names[k] for k in np.frombuffer(self.items[which], np.int32).tolist()]


class Words:
    """The words of one block of documents, each document ended by b"", which no vocabulary holds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        raw, self.listed, counts = data.tobytes(), [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = words(raw[a:b])
            counts.append(len(own))
            self.listed += own
            self.listed.append(b"")
        self.counts = np.array(counts, np.int64)
        self.doc_start = np.concatenate([[0], np.cumsum(self.counts + 1)])


class Shard:
    """Suffix array over the words of one block of documents."""

    def __init__(self, test: TestSet, text: Words, shortest: int, depth: int):
        get = test.vocab.get
        ids = np.fromiter((get(w, 0) for w in text.listed), np.int64, len(text.listed))
        self.doc_start = text.doc_start
        known = np.concatenate([[False], ids > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= shortest
        begin, end = begin[long], end[long]
        sizes = end - begin + 1  # each run with the 0 that ends it
        total = int(sizes.sum())
        self.at = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total) if total else np.zeros(0, np.int64)
        self.text = ids[self.at] if total else np.zeros(0, np.int64)
        self.order = self._sort(depth)

    def _sort(self, depth: int) -> np.ndarray:
        text, n = self.text, len(self.text)
        rank, step = text.copy(), 1
        order = np.argsort(rank, kind="stable")
        while step < depth and n:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] if step < n else 0
            after[rank == 0] = 0  # a suffix ends at its run's end
            key = rank * (n + int(text.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
            zero = text == 0
            new += 1
            new[zero] = 0
            rank, step = new, 2 * step
            if len(np.unique(sorted_key)) == n:
                break
        return order[text[order] > 0]

    def bounds(self, patterns: np.ndarray, lengths: np.ndarray, lo: np.ndarray, hi: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Within the ranges [lo, hi): those whose suffixes, after ``skip`` words, go on with each pattern."""
        text, width = np.concatenate([self.text, np.zeros(skip + patterns.shape[1] + 1, np.int64)]), patterns.shape[1]
        steps, inside = np.arange(width) + skip, np.arange(width)[None, :] < lengths[:, None]
        found = []
        for upper in (False, True):
            low, high = lo.copy(), hi.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                there = text[self.order[mid][:, None] + steps]
                differs = (there != patterns[open_]) & inside[open_]
                first = differs.argmax(1)
                row = np.arange(len(open_))
                less = np.where(differs[row, first], there[row, first] < patterns[open_][row, first], upper)
                low[open_[less]] = mid[less] + 1
                high[open_[~less]] = mid[~less]
            found.append(low)
        return found[0], found[1]

    def search(self, test: TestSet, which: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix array that share the first ``lengths`` words of the test suffixes ``which``."""
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(self.order), np.int64)
        for at in range(0, len(which), BATCH):
            part = slice(at, at + BATCH)
            width = int(lengths[part].max())
            lo[part], hi[part] = self.bounds(test.tokens[test.start[which[part]][:, None] + np.arange(width)], lengths[part], lo[part], hi[part])
        return lo, hi

    def locations(self, test: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct window, shard position, words in common with any item from there) wherever a window occurs: a row for each position and length of windows at most."""
        need = test.need[test.rep]
        lo, hi = self.search(test, test.rep, need) if len(self.order) and len(need) else (np.zeros(len(need), np.int64),) * 2
        much = hi - lo
        window = np.repeat(np.arange(len(need)), much)
        pos = self.order[np.repeat(lo - (np.cumsum(much) - much), much) + np.arange(len(window))]
        length = need[window]
        on = np.flatnonzero(test.high[window] > test.low[window])  # items shorter than a window end with it
        if len(on):
            length[on] = self._follow(test, pos[on], test.low[window[on]], test.high[window[on]])
        return window, pos, length

    def _follow(self, test: TestSet, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Words that the positions share with the test suffixes of their ranges, by jumps of falling powers of two."""
        zero = self.text == 0
        run = np.cumsum(zero) - zero
        hit = np.zeros(int(run[-1]) + 1, bool)
        hit[run[pos]] = True
        inside = hit[run]
        at, own = (np.cumsum(inside) - 1)[pos], self.text[inside]
        ranks, step = [own], 1
        while step < test.longest:
            own, level = ranks[-1], len(ranks)
            after = np.concatenate([own[step:], np.zeros(min(step, len(own)), np.int64)])
            both = np.flatnonzero((own > 0) & (after > 0))
            key = own[both] * (int(test.ranks[level - 1].max()) + 1) + after[both]
            there = np.minimum(np.searchsorted(test.pairs[level], key), len(test.pairs[level]) - 1)
            same = test.pairs[level][there] == key
            if not same.any():
                break
            ranks.append(np.zeros(len(own), np.int64))
            ranks[-1][both[same]] = there[same]
            step *= 2
        length, lo, hi = np.full(len(pos), test.window, np.int64), lo.copy(), hi.copy()
        for k in reversed(range(len(ranks))):
            wanted = ranks[k][at + length]
            live = np.flatnonzero(wanted > 0)
            ends = []
            for upper in (False, True):
                low, high = lo[live], hi[live]
                while (open_ := np.flatnonzero(low < high)).size:
                    mid = (low[open_] + high[open_]) // 2
                    there, goal = test.ranks[k][test.full[mid] + length[live[open_]]], wanted[live[open_]]
                    less = there <= goal if upper else there < goal
                    low[open_[less]] = mid[less] + 1
                    high[open_[~less]] = mid[~less]
                ends.append(low)
            on = ends[0] < ends[1]
            lo[live[on]], hi[live[on]] = ends[0][on], ends[1][on]
            length[live[on]] += 1 << k
        return length

    def longest(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """Words and one shard position of the longest match of every test suffix; the array must be sorted to ``test.longest`` words.

        Ranges are narrowed by a few words at a time; where one gets empty, the place's neighbours share the most.
        """
        n = len(test.start)
        best, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        for at in range(0, n if len(self.order) else 0, BATCH):
            live, skip = np.arange(at, min(at + BATCH, n)), 0
            while len(live):
                patterns = test.tokens[test.start[live][:, None] + skip + np.arange(BATCH_WORDS)]
                lengths = np.minimum(test.left[live] - skip, BATCH_WORDS)
                a, b = self.bounds(patterns, lengths, lo[live], hi[live], skip)
                text = np.concatenate([self.text, np.zeros(skip + BATCH_WORDS + 1, np.int64)])
                for near in (a - 1, a):
                    ok = (near >= lo[live]) & (near < hi[live])
                    pos = self.order[np.where(ok, near, 0)]
                    same = (text[pos[:, None] + skip + np.arange(BATCH_WORDS)] == patterns) & (np.arange(BATCH_WORDS) < lengths[:, None])
                    common = np.where(ok, skip + np.where(same.all(1), BATCH_WORDS, (~same).argmax(1)), 0)
                    better = common > best[live]
                    best[live[better]], where[live[better]] = common[better], pos[better]
                lo[live], hi[live] = a, b
                skip += BATCH_WORDS
                live = live[(a < b) & (test.left[live] > skip)]
        return best, where

    def place(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document row and word index of shard positions."""
        at = self.at[pos]
        doc = np.searchsorted(self.doc_start, at, side="right") - 1
        return doc, at - self.doc_start[doc]


def _parts(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The benchmark's items (name, text, part) and the number of blocks of about ``block_bytes`` of text they make."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.withColumn("part", F.xxhash64("name", "text")), max(1, -(-total // block_bytes))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 1 << 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``keep``, then n_words, n_hit, n_items, items_sha256, contaminated, longest, items, begins, ends.

    ``longest`` is the number of words of the document's longest verbatim match that holds a window (0 if none);
    ``begins`` and ``ends`` are the word ranges hit. The blocks of a large benchmark are prepared one after another on the driver, sent
    to every executor's disk (30 to 50 bytes for each byte of the benchmark, so 30 to 50 MB a block) and loaded one after another in the tasks, in one pass over the documents.
    """
    carried = [f"_k{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)], F.col("text").cast("string").alias("text"))
    schema = docs.select(*keep).schema
    for name, kind in (("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean"),
                       ("longest", "long"), ("items", ArrayType(StringType())), ("begins", ArrayType(IntegerType())), ("ends", ArrayType(IntegerType()))):
        schema = schema.add(name, kind)
    rank, parts = _parts(benchmark, block_bytes)
    sent = []
    for k in range(parts):
        part = rank.where(F.pmod("part", F.lit(parts)) == k).select("name", "text")
        sent.append(docs.sparkSession.sparkContext.broadcast(TestSet([(r.name, r.text) for r in part.toLocalIterator()], window).windows()))
    return rows.mapInArrow(_pass(sent, carried, keep), schema)


#: Item names in one batch of rows that leaves a task; a row with more makes a batch of its own.
BATCH_NAMES = 1 << 20


def _pass(sent: list, carried: list[str], keep: tuple[str, ...]):
    """All blocks of the benchmark against the documents, some MB of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "text"):
                text, n = Words(data, offsets), end - first
                hit, longest = np.zeros(len(text.listed), bool), np.zeros(n, np.int64)
                found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                names: dict[tuple[int, int], list[str]] = {}
                for k, shared in enumerate(sent):
                    test: TestSet = shared.value
                    for doc, which in _search(test, text, hit, longest):
                        found[doc].append((k, which))
                        if (k, which) not in names:
                            names[k, which] = test.named(which)
                    if len(sent) > 1:
                        vars(shared).pop("_value", None)  # loaded again from the executor's disk for the next documents
                        del test
                yield from _rows([batch.slice(first, n).column(c) for c in carried], keep, text, hit, longest, found, names)

    return run


def _search(test: TestSet, text: Words, hit: np.ndarray, longest: np.ndarray) -> list[tuple[int, int]]:
    """Mark the words hit and raise the longest matches; return the (document, set of items) found."""
    shard = Shard(test, text, int(test.need.min(initial=test.window)), test.window)
    window, pos, length = shard.locations(test)
    at = shard.at[pos]
    cover = np.zeros(len(hit) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + test.need[test.rep[window]], -1)
    hit |= np.cumsum(cover)[:-1] > 0
    doc = np.searchsorted(text.doc_start, at, side="right") - 1
    np.maximum.at(longest, doc, length)
    pairs = np.unique(doc * (len(test.items) + 1) + test.sets[window])
    return [divmod(x, len(test.items) + 1) for x in pairs.tolist()]


def _rows(kept: list[pa.Array], keep: tuple[str, ...], text: Words, hit: np.ndarray, longest: np.ndarray, found: list, names: dict) -> Iterator[pa.RecordBatch]:
    n = len(longest)
    padded = np.concatenate([[0], hit.astype(np.int8), [0]])
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    begins, ends = edges[::2], edges[1::2]
    doc = np.searchsorted(text.doc_start, begins, side="right") - 1
    n_hit = np.zeros(n, np.int64)
    np.add.at(n_hit, doc, ends - begins)
    begins, ends = (begins - text.doc_start[doc]).astype(np.int32), (ends - text.doc_start[doc]).astype(np.int32)
    spans = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n)[:n])])
    empty = hashlib.sha256(b"").hexdigest()
    first, many, own, digests, last = 0, 0, [], [], None
    for k in range(n):
        if not found[k]:
            own.append([])
            digests.append(empty)
        elif last is not None and found[k] == found[last]:
            own.append(own[-1])
            digests.append(digests[-1])
        else:
            lists = [names[x] for x in found[k]]
            own.append(lists[0] if len(lists) == 1 else sorted(set().union(*lists)))
            digests.append(hashlib.sha256(",".join(own[-1]).encode()).hexdigest())
        last, many = k, many + len(own[-1])
        if k + 1 == n or many >= BATCH_NAMES:
            part, a, b = slice(first, k + 1), int(spans[first]), int(spans[k + 1])
            sizes = np.diff(spans[first : k + 2])
            yield pa.RecordBatch.from_arrays(
                [*[c.slice(first, k + 1 - first) for c in kept], pa.array(text.counts[part]), pa.array(n_hit[part]), pa.array([len(x) for x in own], pa.int64()), pa.array(digests, pa.string()), pa.array(n_hit[part] > 0),
                 pa.array(longest[part]), pa.array(own, pa.list_(pa.string())), list_array(pa.array(begins[a:b]), sizes), list_array(pa.array(ends[a:b]), sizes)],
                names=[*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "items", "begins", "ends"])
            first, many, own, digests, last = k + 1, 0, [], [], None


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 1 << 20) -> DataFrame:
    """For every test suffix with a match: item_id, item_word, length (words), doc_id and doc_word of one longest verbatim match."""
    docs_ = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rank, parts = _parts(benchmark, block_bytes)
    out = None
    for k in range(parts):
        own = rank.where(F.pmod("part", F.lit(parts)) == k)
        shared = docs.sparkSession.sparkContext.broadcast(TestSet([(r.name, r.text) for r in own.select("name", "text").toLocalIterator()], 1))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            test: TestSet = shared.value
            for batch in batches:
                for first, _, data, offsets in blocks(batch, "text"):
                    shard = Shard(test, Words(data, offsets), 1, test.longest)
                    best, pos = shard.longest(test)
                    some = np.flatnonzero(best > 0)
                    doc, word = shard.place(pos[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([test.names[x] for x in test.item[some].tolist()], pa.string()), pa.array(test.word[some]), pa.array(best[some]), batch.column("doc_id").take(pa.array(doc + first)), pa.array(word)],
                        names=["item_id", "item_word", "length", "doc_id", "doc_word"])

        part = cut(docs_.mapInArrow(run, "item_id string, item_word long, length long, doc_id long, doc_word long"), "longest-matches")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "doc_word")).alias("best"))
    return best.select("item_id", "item_word", (-F.col("best.less")).alias("length"), "best.doc_id", "best.doc_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit, with all their columns; no row is shuffled."""
    names = docs.columns
    marked = [f"_c{k}" for k in range(len(names))]  # free of clashes with the columns added
    plain = docs.toDF(*marked).withColumn("text", F.col(marked[names.index("text")]))
    return contamination(plain, benchmark, window, keep=tuple(marked)).where("NOT contaminated").select(*marked).toDF(*names)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS g
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dg AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM dg JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
