"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes meets a mask. A chunk's identifier is the
first half of its SHA-256 digest, verified against length and full digest over the whole corpus. A
document becomes the ordered list of its chunks' identifiers (its recipe); texts are equal when the
recipes are. Only recipes are shuffled, never texts, so long documents move once, from the scan.

Defined cases: a null text equals an empty one (a recipe without chunks); rows that repeat both
doc_id and text are one document and are all marked kept; null doc_ids lose to any other id, and a
group of nulls alone has a null keep_id and is kept; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.llm.arrow_text import blocks
from socialspark.sources.scratch import cut

WINDOW = 32
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def chunk_ends(data: np.ndarray, offsets: np.ndarray, bits: int, longest: int) -> list[np.ndarray]:
    """Ends of each document's chunks, relative to the document. A cut depends on the 32 bytes before it only."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h = h + shifted
    cuts = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    out = []
    at = np.searchsorted(cuts, offsets)
    for d in range(len(offsets) - 1):
        start, end = int(offsets[d]), int(offsets[d + 1])
        own = cuts[at[d] : at[d + 1] + 1] - start
        own = own[(own >= WINDOW) & (own < end - start)]
        ends = np.append(own, end - start) if end > start else np.zeros(0, np.int64)
        if len(ends) and np.diff(ends, prepend=0).max() > longest:
            full, last = [], 0
            for e in ends.tolist():
                full.extend(range(last + longest, e, longest))
                full.append(e)
                last = e
            ends = np.array(full)
        out.append(ends)
    return out


def recipes(docs: DataFrame, bits: int = 12, longest: int = 1 << 16) -> DataFrame:
    """doc_id, text_sha256 (hex), recipe (identifiers, 16 bytes each), chunks (identifier, length, digest)."""
    fields = "doc_id long, text_sha256 string, recipe binary, chunks array<struct<id:binary,n:int,digest:binary>>"
    chunk_type = pa.list_(pa.struct([("id", pa.binary()), ("n", pa.int32()), ("digest", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "text"):
                raw, sha, recipe, chunks = data.tobytes(), [], [], []
                for d, ends in enumerate(chunk_ends(data, offsets, bits, longest)):
                    start, last, own = int(offsets[d]), 0, []
                    sha.append(hashlib.sha256(raw[start : int(offsets[d + 1])]).hexdigest())
                    for e in ends.tolist():
                        digest = hashlib.sha256(raw[start + last : start + e]).digest()
                        own.append({"id": digest[:16], "n": e - last, "digest": digest[16:]})
                        last = e
                    recipe.append(b"".join(c["id"] for c in own))
                    chunks.append(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(sha), pa.array(recipe, pa.binary()), pa.array(chunks, chunk_type)],
                    names=["doc_id", "text_sha256", "recipe", "chunks"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)


def verified_chunks(rows: DataFrame) -> DataFrame:
    """The chunk store: one row per identifier with its length and copies. An identifier with two contents stops the job."""
    store = (
        rows.select(F.explode("chunks").alias("c"))
        .groupBy(F.col("c.id").alias("chunk_id"))
        .agg(
            F.min("c.n").alias("n_bytes"), F.max("c.n").alias("n_max"),
            F.min("c.digest").alias("digest"), F.max("c.digest").alias("digest_max"), F.count("*").alias("copies"),
        )
    )
    same = (F.col("n_bytes") == F.col("n_max")) & (F.col("digest") == F.col("digest_max"))
    return store.where(F.when(same, True).otherwise(F.raise_error(F.lit("two chunks share an identifier")))).select("chunk_id", "n_bytes", "copies")


def exact_groups(docs: DataFrame, bits: int = 12, longest: int = 1 << 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(recipes(docs, bits, longest), "recipes")
    verified_chunks(rows).agg(F.sum("copies")).collect()  # one number; raises if a verification fails
    groups = cut(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    # Both sides are plain scans, so that adaptive execution can split a recipe that very many rows share.
    return rows.select("doc_id", "text_sha256", "recipe").join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    names = docs.columns
    own = [f"c{k}" for k in range(len(names))]  # free of clashes with the columns compared
    doc_id, text = own[names.index("doc_id")], own[names.index("text")]
    kept = exact_groups(docs).where("kept").select("doc_id", "text_sha256").distinct()
    same = F.col(doc_id).eqNullSafe(F.col("doc_id")) & (F.sha2(F.coalesce(F.col(text), F.lit("")), 256) == F.col("text_sha256"))
    return docs.toDF(*own).join(kept, same, "left_semi").toDF(*names)


SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
