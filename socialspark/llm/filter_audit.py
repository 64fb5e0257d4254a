"""Audit of five filters in every order, over a sparse document-term matrix.

Tasks cut texts into blocks of about 4 MB and write a block as one CSR shard with words numbered inside the block, its
distinct words dealt to buckets by hash, and what the other filters need. A bucket's words of all blocks meet in one task,
which numbers them as they pass (it holds the bucket's distinct words, not their blocks); each block's numbers then meet
its shard again, which is now a shard of the global matrix: row sums are words, nonzero entries distinct words. So what
is shuffled are a block's distinct words and its shard in short form, never texts. Flags become one mask of five bits for
each document, masks are counted by part, and the 120 orders are worked out from the 32 counts of a part.

Failures: A under 200 words; B 100 x distinct words < 50 x words; C 100 x capitals A-Z > 2 x code points; D holds one
of ``#$%&*|``; E equals the text of a smaller doc_id. Words are runs without ASCII white space, case-sensitive.

Defined cases: null text is empty (fails A, and is a copy of empty texts with a smaller doc_id); a null doc_id is neither
smaller nor larger than any other, so that row fails no E, and has no label; rows that repeat doc_id and text are no
copies of each other; a document counts as good or toxic once if any of its label rows says so; a null source and an
empty one are the part ``''``; words of over 256 bytes stand in the dictionary as length and SHA-256; an empty table
gives no rows; further columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.llm.arrow_text import blocks, list_array
from socialspark.sources.scratch import cut, discard

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 2  # percent of the code points
SIGNS = b"#$%&*|"
BLOCK_BYTES = 4 << 20
LONG_WORD = 256
BUCKETS = 2048
MASKS = 1 << len(FILTERS)

SHARD = (
    "block long, doc_id array<long>, source array<string>, digest array<binary>, c array<boolean>, d array<boolean>, "
    "length array<int>, terms binary, counts binary, words array<struct<bucket:int,start:int,words:binary>>"
)
MATRIX = "block long, doc_id array<long>, source array<string>, digest array<binary>, c array<boolean>, d array<boolean>, length array<int>, term array<long>, count array<long>"
ROWS = "doc_id long, source string, digest binary, n_words long, n_distinct long, c boolean, d boolean"


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers in as many bytes of seven bits as each needs, lowest first."""
    v = values.astype(np.int64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 9):
        if not (more := v >> (7 * k) > 0).any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[at[own] + k] = (v[own] >> (7 * k)) & 127 | np.where(size[own] > k + 1, 128, 0)
    return out.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), begins)


def row_starts(length: np.ndarray) -> np.ndarray:
    return np.cumsum(length, dtype=np.int64) - length


def packed_terms(term: np.ndarray, length: np.ndarray) -> bytes:
    """Ascending numbers of each row as steps from the one before."""
    steps = np.diff(term.astype(np.int64), prepend=0)
    first = row_starts(length)[length > 0]
    steps[first] = term[first]
    return packed(steps)


def unpacked_terms(raw: bytes, length: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(unpacked(raw))])
    return total[1:] - np.repeat(total[row_starts(length)], length)


def dictionary_key(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\0long:%d:%s" % (len(word), hashlib.sha256(word).hexdigest().encode())


def block_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """CSR of one block: entries a document, word numbers (ascending by document), counts; and the words by bucket.

    Numbers follow the buckets, so a bucket's words have the numbers from its start on.
    """
    raw, words, sizes = data.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = raw[a:b].split()  # bytes split at 0x09-0x0D and 0x20
        words.extend(own)
        sizes.append(len(own))
    if any(len(w) > LONG_WORD for w in words):
        words = [dictionary_key(w) for w in words]
    coded = pa.array(words, pa.binary()).dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    bucket = np.array([crc32(w) % BUCKETS for w in vocabulary], np.int64)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
    places = order.tolist()
    ends = [*starts[1:], len(places)] if starts else []
    by_bucket = [{"bucket": int(bucket[places[a]]), "start": a, "words": b" ".join([vocabulary[k] for k in places[a:b]])} for a, b in zip(starts, ends, strict=True)]
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    cell, count = np.unique(row * max(len(order), 1) + number[coded.indices.to_numpy()], return_counts=True)
    rows, term = np.divmod(cell, max(len(order), 1))
    return np.bincount(rows, minlength=len(sizes)), term, count, by_bucket


def by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags set in each row's bytes."""
    before = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=before[1:])
    return before[offsets[1:]] - before[offsets[:-1]]


def shards(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a block: documents, flags of C and D, digests, CSR with the block's own word numbers, its words by bucket."""
    words = pa.struct([("bucket", pa.int32()), ("start", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        one = lambda values, n: list_array(values, np.array([n]))
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "text", block_bytes):
                n = end - first
                length, term, count, by_bucket = block_terms(data, offsets)
                capitals = by_row((data >= 65) & (data <= 90), offsets)
                points = by_row((data & 0xC0) != 0x80, offsets)
                signs = by_row(np.isin(data, np.frombuffer(SIGNS, np.uint8)), offsets) > 0
                raw = data.tobytes()
                digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), one(batch.column("doc_id").slice(first, n), n), one(batch.column("source").slice(first, n).cast(pa.string()), n),
                        one(pa.array(digest, pa.binary()), n), one(pa.array(100 * capitals > MOST_CAPITALS * points), n), one(pa.array(signs), n),
                        one(pa.array(length, pa.int32()), n), pa.array([packed_terms(term, length)], pa.binary()), pa.array([packed(count)], pa.binary()),
                        one(pa.array(by_bucket, words), len(by_bucket)),
                    ],
                    names=["block", "doc_id", "source", "digest", "c", "d", "length", "terms", "counts", "words"],
                )
                number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, SHARD)


def numbering(written: DataFrame) -> DataFrame:
    """One row per block and bucket: part, block, start, ids (numbers within the part, 4 bytes each), first, n_fresh, fresh
    (the words that the part met here first, with the numbers from ``first`` on). Written, so that numbers stay when tasks run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, first, fresh, n_fresh = [], [], [], []
            for blob in batch.column("words").to_pylist():
                words, new = blob.split(b" "), len(known)
                ids.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32).tobytes())
                first.append(new)
                n_fresh.append(len(known) - new)
                fresh.append(b" ".join([w for w, k in zip(words, np.frombuffer(ids[-1], np.int32).tolist(), strict=True) if k >= new]))
            columns = [pa.array([part] * len(ids), pa.int64()), batch.column("block"), batch.column("start"), pa.array(ids, pa.binary()), pa.array(first, pa.int64()), pa.array(n_fresh, pa.int64()), pa.array(fresh, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "start", "ids", "first", "n_fresh", "fresh"])

    rows = written.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.start", "w.words").repartition("bucket")
    return cut(rows.select("block", "start", "words").mapInArrow(run, "part long, block long, start int, ids binary, first long, n_fresh long, fresh binary"), "word-numbers")


def part_starts(numbers: DataFrame) -> dict[int, int]:
    """Global number of each part's first word: one entry a task of :func:`numbering`."""
    out, total = {}, 0
    for r in sorted(numbers.groupBy("part").agg(F.sum("n_fresh").alias("n")).collect()):
        out[r.part] = total
        total += r.n
    return out


def dictionary(numbers: DataFrame) -> DataFrame:
    """word (binary), word_id: all distinct words, numbered from 0 without gaps."""
    starts = part_starts(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, fresh in zip(*[batch.column(c).to_pylist() for c in ("part", "first", "fresh")], strict=True):
                words = fresh.split(b" ")
                begin = starts[part] + first
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(range(begin, begin + len(words)), pa.int64())], names=["word", "word_id"])

    return numbers.where("n_fresh > 0").select("part", "first", "fresh").mapInArrow(run, "word binary, word_id long")


def _global(batches: Iterator[pa.RecordBatch], starts: dict[int, int]) -> Iterator[dict]:
    """A joined shard's columns with term and count unpacked, terms under global numbers and ascending by document."""
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1)
            length = row.column("length").flatten().to_numpy()
            own, count = unpacked_terms(row.column("terms")[0].as_py(), length), unpacked(row.column("counts")[0].as_py())
            number = np.zeros(int(own.max(initial=-1)) + 1, np.int64)
            for n in row.column("numbers")[0].as_py() or []:
                ids = np.frombuffer(n["ids"], np.int32)
                number[n["start"] : n["start"] + len(ids)] = ids + starts[n["part"]]
            term = number[own]
            order = np.lexsort((term, np.repeat(np.arange(len(length)), length)))
            yield {"row": row, "length": length, "term": term[order], "count": count[order]}


def with_numbers(written: DataFrame, numbers: DataFrame) -> DataFrame:
    lists = numbers.groupBy("block").agg(F.collect_list(F.struct("part", "start", "ids")).alias("numbers"))  # one entry a bucket
    return written.drop("words").join(lists, "block", "left")


def document_term_matrix(written: DataFrame, numbers: DataFrame) -> DataFrame:
    """The written shards with global word numbers (``MATRIX``): documents' entries one after another, ``length`` of each."""
    starts = part_starts(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = ("block", "doc_id", "source", "digest", "c", "d", "length")
        for s in _global(batches, starts):
            lists = [list_array(pa.array(s[c], pa.int64()), np.array([len(s[c])])) for c in ("term", "count")]
            yield pa.RecordBatch.from_arrays([*[s["row"].column(c) for c in same], *lists], names=[*same, "term", "count"])

    return with_numbers(written, numbers).mapInArrow(run, MATRIX)


def matrix_rows(written: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row a document of the matrix: doc_id, source, digest, n_words (row sum), n_distinct (nonzero entries), c, d."""
    starts = part_starts(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _global(batches, starts):
            length, sums = s["length"], np.concatenate([[0], np.cumsum(s["count"])])
            begins = row_starts(length)
            new = np.diff(s["term"], prepend=-1) != 0  # within a row, entries of one word would be one nonzero
            new[begins[length > 0]] = True
            nonzero = np.concatenate([[0], np.cumsum(new)])
            flat = {c: s["row"].column(c).flatten() for c in ("doc_id", "source", "digest", "c", "d")}
            yield pa.RecordBatch.from_arrays(
                [flat["doc_id"], flat["source"], flat["digest"], pa.array(sums[begins + length] - sums[begins]), pa.array(nonzero[begins + length] - nonzero[begins]), flat["c"], flat["d"]],
                names=["doc_id", "source", "digest", "n_words", "n_distinct", "c", "d"],
            )

    return with_numbers(written, numbers).mapInArrow(run, ROWS)


def failures(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, source, mask of the filters it fails (bit 0 is A)."""
    written = cut(shards(docs, block_bytes), "term-shards")
    numbers = numbering(written)
    rows = cut(matrix_rows(written, numbers), "term-rows")
    discard(written), discard(numbers)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    flags = [F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), F.col("c"), F.col("d"), F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(flags[1:], 1)), flags[0].cast("int"))
    return rows.join(first, "digest", "left").select("doc_id", "source", mask.alias("mask"))


def counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, n, good, toxic: documents by mask (arrays of 32), of all and of the labelled ones."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flat = failed.join(known, "doc_id", "left").groupBy(F.coalesce("source", F.lit("")).alias("part"), "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    cells = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(MASKS)]).alias(c)
    return flat.groupBy("part").agg(cells("n"), cells("good"), cells("toxic"))


def steps() -> Column:
    """All orders' steps: filter_order, step, bit of its filter, bits of the filters before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        for s, k in enumerate(order):
            out.append(F.struct(F.lit(name).alias("filter_order"), F.lit(s + 1).alias("step"), F.lit(1 << k).alias("bit"), F.lit(sum(1 << b for b in order[:s])).alias("before")))
    return F.array(*out)


def audit(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    parts = counts(failures(docs, block_bytes), labels)
    bit, before = F.col("s.bit"), F.col("s.before")

    def total(cells: str, takes) -> Column:
        """Sum of the counts whose mask ``takes`` accepts."""
        return F.aggregate(F.transform(cells, lambda v, m: F.when(takes(m), v).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, v: a + v)

    fails = lambda m: m.bitwiseAND(bit) != 0
    early = lambda m: m.bitwiseAND(before) != 0
    # of all orders, a filter comes before a document's other failing ones in 120 / (filters it fails)
    orders = F.lit(120)
    shapley = F.aggregate(F.transform("n", lambda v, m: F.when(fails(m), v * (orders / F.bit_count(m)).cast("long")).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, v: a + v)
    return parts.select("part", "n", "good", "toxic", F.explode(steps()).alias("s")).select(
        "part", "s.filter_order", "s.step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", lambda m: fails(m) & ~early(m)).alias("removed"),
        total("n", lambda m: fails(m) & early(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~early(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & ~early(m)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
copies AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * list_unique(words) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text))::INT
    + 8 * regexp_matches(w.text, '[#$%&*|]')::INT + 16 * coalesce(c.first < w.doc_id, false)::INT AS mask
  FROM w JOIN copies c ON c.text = w.text LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
letter(k, name) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM letter a JOIN letter b ON b.k <> a.k JOIN letter c ON c.k NOT IN (a.k, b.k)
    JOIN letter d ON d.k NOT IN (a.k, b.k, c.k) JOIN letter e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT filter_order, step, 1 << ks[step] AS bit, coalesce(list_sum(list_transform(ks[1:step - 1], lambda k: 1 << k)), 0)::INT AS before FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
