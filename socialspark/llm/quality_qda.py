"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text gives a few statistics of its bytes, words and lines, log-transformed. Each class has a mean
and a covariance shrunk towards the pooled covariance and a scaled identity; its Cholesky factor is
computed once and sent to the tasks. The score is the logistic of the difference of the two log
densities (half the difference of squared Mahalanobis distances plus log determinants) and log priors.

The fit reads at most ``fit_rows`` labelled documents, chosen by a hash of doc_id among those whose
CRC-32 of doc_id as text is not 0 modulo 5, and gathers only sums and outer products per class.

Defined cases: null and empty texts have the statistics of an empty text and get a score; null labels
and null doc_ids teach nothing; repeated rows are scored one by one and count as often as they occur; a
class without examples takes the pooled statistics (score = prior); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.llm.arrow_text import blocks
from socialspark.sources.scratch import cut, discard

THRESHOLD = 0.3
#: Bytes of text per numpy step; a longer text makes a step of its own.
STEP = 1 << 20
FEATURES = ("bytes", "words", "word_length", "upper", "digit", "punctuation", "symbol", "bar", "non_ascii", "space", "word_variety", "repeated_neighbour", "line_variety", "top_word", "capital_words")
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1  # upper
_KIND[48:58] = 2  # digit
_KIND[[*range(33, 35), 39, 40, 41, 44, 45, 46, 47, 58, 59, 63]] = 3  # punctuation of prose
_KIND[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]] = 4  # symbols
_KIND[124] = 5  # bar
_KIND[128:] = 6
_KIND[[9, 10, 11, 12, 13, 32]] = 7
_POW = np.cumprod(np.full(1 << 8, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit mark per piece: length, and a sum of its bytes times powers by place (first 256 bytes in step)."""
    at = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data)))) if len(begin) and begin[0] == 0 else None
    if at is None:
        start = np.concatenate([[0], begin])
        at = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW[at & 255], dtype=np.uint64)])
    return (sums[end] - sums[begin]) ^ ((end - begin).astype(np.uint64) << np.uint64(48))


def _variety(marks: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct marks and the most frequent one's count, per document."""
    order = np.lexsort((marks, doc))
    m, d = marks[order], doc[order]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, d[first], np.diff(np.append(first, len(m))))
    return np.bincount(d[first], minlength=n)[:n].astype(float), top


def _pieces(data: np.ndarray, part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of the maximal runs of bytes where ``part`` is false; documents part too."""
    inside = ~part
    begins = inside.copy()
    begins[1:] &= part[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = inside[edge]
    begin = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, bool)
    stops[:-1] = part
    stops[offsets] = True
    at = np.flatnonzero(stops)
    end = at[np.searchsorted(at, begin, side="right")] if len(begin) else begin
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics, one row per document."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kind = _KIND[data]
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(doc_of * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    begin, end, doc = _pieces(data, kind == 7, offsets)
    words = np.bincount(doc, minlength=n)[:n].astype(float)
    marks = _hashes(data, begin, end)
    distinct, top = _variety(marks, doc, n)
    twin = np.zeros(len(marks), bool)
    twin[1:] = (marks[1:] == marks[:-1]) & (doc[1:] == doc[:-1])
    twins = np.bincount(doc[twin], minlength=n)[:n]
    capital = np.bincount(doc[kind[begin] == 1], minlength=n)[:n] if len(begin) else np.zeros(n)
    line_begin, line_end, line_doc = _pieces(data, data == 10, offsets)
    lines = np.bincount(line_doc, minlength=n)[:n].astype(float)
    line_kinds, _ = _variety(_hashes(data, line_begin, line_end), line_doc, n)
    # Shares lean towards values of ordinary prose where there is little text.
    share = lambda x, of, usual, weight: (x + usual * weight) / (of + weight)
    rare = lambda x: np.log(x + 0.003)
    byte = lambda k, usual: rare(share(count[:, k], size, usual, 40.0))
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p(share(size - count[:, 7], words, 5.0, 8.0)), byte(1, 0.02), byte(2, 0.0), byte(3, 0.03),
        byte(4, 0.0), byte(5, 0.0), byte(6, 0.02), byte(7, 0.16), np.log(share(distinct, words, 0.9, 8.0)), rare(share(twins, words, 0.0, 8.0)),
        np.log(share(line_kinds, lines, 1.0, 2.0)), rare(share(top, words, 0.06, 20.0)), rare(share(capital, words, 0.12, 8.0)),
    ], 1)


@dataclass
class Model:
    """Means, Cholesky factors of the covariances with their inverses, log determinants and log priors of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverses[c].T
            logs.append(self.log_priors[c] - 0.5 * (z * z).sum(1) - self.log_dets[c])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def fit_model(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], towards_pooled: float = 0.3, towards_identity: float = 0.01) -> Model:
    """From per-class (count, sum, sum of outer products)."""
    d = len(FEATURES)
    none = (0.0, np.zeros(d), np.zeros((d, d)))
    parts = [sums.get(c, none) for c in (0, 1)]
    total = sum(p[0] for p in parts)
    mean_all = (parts[0][1] + parts[1][1]) / max(total, 1)
    within = np.eye(d) * 1e-3
    if total:
        within = within + sum(p[2] - np.outer(p[1], p[1]) / max(p[0], 1) for p in parts) / total
    means, factors, dets, priors = [], [], [], []
    for n, s, o in parts:
        mean = s / n if n else mean_all
        own = o / n - np.outer(mean, mean) if n else within
        weight = n / (n + d)
        cov = weight * own + (1 - weight) * within
        cov = (1 - towards_pooled) * cov + towards_pooled * within
        cov = (1 - towards_identity) * cov + towards_identity * np.trace(cov) / d * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(factor)
        dets.append(np.log(np.diag(factor)).sum())
        priors.append(np.log((n + 1) / (total + 2)))
    return Model(np.array(means), np.array(factors), np.array([np.linalg.inv(f) for f in factors]), np.array(dets), np.array(priors))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


SETTINGS = [(p, i) for p in (0.1, 0.3, 0.6) for i in (0.003, 0.01, 0.03)]
FOLDS = 4


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Model:
    """Learn ``labels.quality`` from at most ``fit_rows`` label rows outside the held-out fifth.

    The two shrinkage weights are those of ``SETTINGS`` with the least log loss in cross-validation by ``FOLDS`` folds
    of those rows; the held-out fifth has no part in it.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("_id"), "quality")
    chosen = chosen.where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id", "quality").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string")).join(F.broadcast(chosen), "_id")
    rows = rows.select(F.col("quality").cast("int").alias("quality"), F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    d = len(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "text", STEP):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("quality").slice(first, end - first), batch.column("fold").slice(first, end - first), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float64()))], names=["quality", "fold", "x"])

    measured = cut(rows.mapInArrow(measure, "quality int, fold int, x array<double>"), "label-statistics")  # of the sample only

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, y, f = _unpacked(batch)
            for c in (0, 1):
                for k in range(FOLDS):
                    own = x[(y == c) & (f == k)]
                    got[k, c] = got.get((k, c), 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([c for _, c in got], pa.int32()), pa.array([v.tolist() for v in got.values()], pa.list_(pa.float64()))], names=["fold", "class", "sums"])

    parts = measured.mapInArrow(gather, "fold int, class int, sums array<double>")
    summed = parts.select("fold", "class", F.posexplode("sums")).groupBy("fold", "class", "pos").agg(F.sum("col").alias("v"))
    sums: dict[tuple[int, int], np.ndarray] = {}
    for k, c, v in summed.groupBy("fold", "class").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("s")).collect():  # FOLDS * 2 rows of d * d numbers
        sums[k, c] = np.array([x.v for x in v])

    def without(fold: int | None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        flat = {c: sum((v for (k, w), v in sums.items() if w == c and k != fold), np.zeros(1 + d + d * d)) for c in (0, 1)}
        return {c: (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for c, v in flat.items()}

    shared = docs.sparkSession.sparkContext.broadcast([[fit_model(without(k), *s) for k in range(FOLDS)] for s in SETTINGS])

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SETTINGS))
        for batch in batches:
            x, y, f = _unpacked(batch)
            for s, models in enumerate(shared.value):
                for k in range(FOLDS):
                    p = np.clip(models[k].score(x[f == k]), 1e-6, 1 - 1e-6)
                    total[s] -= np.log(np.where(y[f == k] == 1, p, 1 - p)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(SETTINGS), dtype=np.int32)), pa.array(total)], names=["setting", "loss"])

    loss = {r.setting: r.loss for r in measured.mapInArrow(losses, "setting int, loss double").groupBy("setting").agg(F.sum("loss").alias("loss")).collect()}  # a row a setting
    shared.unpersist()
    discard(measured)
    best = min(range(len(SETTINGS)), key=lambda s: (round(loss.get(s, 0.0), 6), s))
    return fit_model(without(None), *SETTINGS[best])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
    return x, batch.column("quality").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)


def scores(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id (or the columns ``keep``, which may not be called score or predicted), score and predicted, one row per document."""
    keep = keep or ["doc_id"]
    if {c.lower() for c in keep} & {"score", "predicted"}:
        raise ValueError("columns named score or predicted can't be kept beside the results")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "_text", STEP):
                s = shared.value.score(statistics(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, end - first) for c in keep] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = rows.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, schema)
