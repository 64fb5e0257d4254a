"""Token-ID output: Parquet list columns, written in document order and read back selectively.

Format: a folder of Parquet files sorted by doc_id, files in name order. Columns: doc_id, shard (the
file's number), shard_start (ids of the shard's documents before this one), n_tokens, tokens
(array<int>). The tokens column is dictionary or delta encoded; row-group and page sizes are
parameters, and the writer adds column and offset indexes, so a reader of doc_id and n_tokens touches
no token page and a doc_id range touches only its own pages.

Defined cases: a null or empty text is the end id alone; rows with equal doc_id are ordered by the
64-bit hash of their text (equal rows are alike, so their order says nothing); null doc_ids come first; an empty table gives an empty folder with the schema; other
columns are not read. Added tokens that occur in a text are taken as the tokenizer file defines them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.llm.arrow_text import blocks, list_array
from socialspark.sources.scratch import new_path

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, tokens array<int>"
_LATIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)").fullmatch
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters that byte-level models write for bytes: printable ones themselves, the others from 256 on.
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PLAIN)}
#: Pieces that a worker remembers between blocks, at some 130 bytes each.
MEMO_ENTRIES = 400_000
#: Of texts that are encoded at a time; their pieces are looked up once each.
BLOCK_BYTES = 1 << 20
_encoders: dict[tuple[str, int], PieceEncoder] = {}


class Memo:
    """Ids of pieces as little-endian bytes; none for a piece that needs its neighbours.

    At most ``entries`` pieces are held, in two halves: when the newer one is full it becomes the older one, whose
    pieces come back as they are used again, so that common pieces stay and rare ones go.
    """

    def __init__(self, tok, direct: bool, entries: int):
        self.tok, self.direct, self.half, self.newer, self.older = tok, direct, max(entries // 2, 1), {}, {}
        self.tokenize = tok.model.tokenize  # reading ``tok.model`` makes an object each time

    def _pretoken(self, token: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(token.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()

    def _ids(self, piece: str) -> bytes:
        if self.direct and piece[0] == " " and piece.isascii() and piece[1:].isalpha():  # the most common form
            return array("I", [t.id for t in self.tokenize("Ġ" + piece[1:])]).tobytes()
        m = _LATIN(piece) if self.direct else None
        if m:
            lead, word, marks = m.groups()
            ids = b""
            if lead == "\n":
                ids, lead = self._pretoken("\n"), ""
            if word:
                ids, lead = ids + self._pretoken(lead + word), ""
            if marks:
                return ids + self._pretoken(lead + marks)
            return b"" if lead or not word else ids
        body = piece[1:] if piece[0] in " \n" else piece
        return b"" if not body or body[0].isspace() or body[-1].isspace() else array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Of different pieces that are not empty."""
        known = list(map(self.newer.get, pieces))
        late = [k for k, x in enumerate(known) if x is None]
        for k in late:
            known[k] = x if (x := self.older.get(pieces[k])) is not None else self._ids(pieces[k])
        for at in range(0, len(late), self.half):
            part = late[at : at + self.half]
            if len(self.newer) + len(part) > self.half:
                self.newer, self.older = {}, self.newer
            self.newer.update((pieces[k], known[k]) for k in part)
        return known


class PieceEncoder:
    """Encodes blocks of texts by their different pieces, which are led by a space or a newline, through a bounded memo.

    A single space or newline between two characters that are not white space always starts a new
    pre-token of a byte-level tokenizer, so the ids of a text are the joined ids of its pieces. Texts
    with other white space next to such a cut, or with an added token's string, are encoded whole.
    """

    def __init__(self, path: str, entries: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        # Words of Latin letters go straight to the library's model: its pre-tokens are the word with its space, and the marks after it.
        self.direct = json.loads(self.tok.to_str())["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and self.tok.normalizer is None
        self.memo = Memo(self.tok, self.direct, entries)

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _starts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where pieces start, given the starts of texts."""
        gap = (data == 32) | (data == 10)
        cut = gap.copy()
        if self.direct and len(data) > 2:  # a mark after a letter and before a space or newline is a pre-token of its own
            at = np.flatnonzero(((data == 46) | (data == 44))[1:-1] & gap[2:]) + 1
            last, lead = data[at - 1], data[at - 2]  # at 1 the lead is the block's last byte, which only a stray one follows
            latin = (lead == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
            cut[at[((last | 32) - 97 < 26) & (last < 128) | latin & (at > 1)]] = True
        cut[texts] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block (their UTF-8 bytes and where they start), each with the end id, and their numbers of ids."""
        end = np.array([end_id], "<u4").tobytes()
        starts = self._starts(data, offsets[:-1][np.diff(offsets) > 0])
        # every text is followed by an empty piece, which stands for its end
        ends = np.searchsorted(starts, offsets[1:])
        at = np.append(np.insert(starts, ends, offsets[1:]), offsets[-1]).astype(np.int32)
        ends = ends + np.arange(len(ends))
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        empty = names.index("")
        names[empty : empty + 1] = []
        known = self.memo.ids(names)
        known.insert(empty, end)
        index = pieces.indices.to_numpy()
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = np.frombuffer(b"".join(known), "<i4")
        each = lengths[index]
        upto = np.cumsum(each)
        values = ids[np.repeat((np.cumsum(lengths) - lengths)[index] - (upto - each), each) + np.arange(upto[-1])]
        n = np.diff(upto[ends], prepend=0)

        raw = data.tobytes()
        whole = {int(np.searchsorted(offsets, m.start(), side="right")) - 1 for a in self.added for m in re.finditer(re.escape(a), raw)}
        apart = lengths == 0  # pieces that need their neighbours
        if apart.any():
            whole.update(np.searchsorted(ends, np.flatnonzero(apart[index])).tolist())
        if whole:
            texts = np.split(values, np.cumsum(n)[:-1])
            for k in whole:
                texts[k] = np.frombuffer(self.whole(raw[offsets[k] : offsets[k + 1]].decode()) + end, "<i4")
            values, n = np.concatenate(texts), np.array([len(t) for t in texts], np.int64)
        return values, n


def encode_sorted(docs: DataFrame, tokenizer: str, end_id: int, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """Documents in ascending doc_id order over range partitions, encoded: the rows of the format.

    Below doc_id the ranges go by the text's hash and the row's place, so that the rows of one doc_id, or of one
    doc_id with one text, spread over as many tasks as they need.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, memo_entries) not in _encoders:
            _encoders[tokenizer, memo_entries] = PieceEncoder(tokenizer, memo_entries)
        encoder, shard, at = _encoders[tokenizer, memo_entries], TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, after, data, offsets in blocks(batch, "text", BLOCK_BYTES):
                ids, n = encoder.encode(data, offsets, end_id)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, after - first), pa.array(np.full(len(n), shard, np.int32)), pa.array(starts), pa.array(n), list_array(pa.array(ids), n)],
                    schema=arrow,
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("place"))
    return keyed.repartitionByRange("doc_id", "text_hash", "place").sortWithinPartitions("doc_id", "text_hash", "place").select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(rows: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    (
        rows.write.option("compression", "snappy")
        .option("parquet.writer.version", "v2")  # delta encoding for integers without a dictionary
        .option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower())
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.dictionary.page.size", str(1 << 20))
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _placed(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` of stored files with ``start`` for their shard's place and their own in it."""
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per file: small enough to send to all tasks
    bases = shards.selectExpr("shard", "sum(n) OVER (ORDER BY shard) - n AS base")
    return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("shard_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows with ``start``: ids of all documents before each one. Select what you need; token pages load only if asked for."""
    stored = _stored(spark, path)
    return _placed(stored, stored).select("doc_id", "start", "n_tokens", "tokens")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``token_digests`` of the rows, taken before they meet their shard's place, so that only the digests pass that join."""
    stored = _stored(spark, path)
    digests = token_digests(stored.select("doc_id", "shard", "shard_start", "n_tokens", "tokens"))
    return _placed(digests, stored).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_digests(rows: DataFrame) -> DataFrame:
    """The rows with, in place of the ids, the CRC-32 of each document's ids as little-endian unsigned integers."""
    kept = rows.drop("tokens").schema
    names = list(kept.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("tokens")
            offsets = col.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(col.values.to_numpy().astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    return rows.mapInArrow(run, kept.add("ids_crc32", "long"))


def _write(docs: DataFrame, tokenizer: str, end_id: int, path: str | None, memo_entries: int, **layout) -> str:
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(encode_sorted(docs, tokenizer, end_id, memo_entries), path, **layout)
    return path


def token_table(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, memo_entries: int = MEMO_ENTRIES, **layout) -> DataFrame:
    """Encode, write in the format (in the shared folder unless ``path`` is given), and read back."""
    return read_tokens(docs.sparkSession, _write(docs, tokenizer, end_id, path, memo_entries, **layout))


def digest_table(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, memo_entries: int = MEMO_ENTRIES, **layout) -> DataFrame:
    """The same with the digest of each document's ids as read back."""
    return read_digests(docs.sparkSession, _write(docs, tokenizer, end_id, path, memo_entries, **layout))
