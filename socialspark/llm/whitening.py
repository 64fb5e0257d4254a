"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Entries become x = floor(256 c). Over the distinct x (the fit list: n vectors with sums S) tasks add up the Gram matrix
in exact integers, and M = n X'X - S S', which is n^2 times the covariance, is known exactly. Its characteristic
polynomial comes from Hessenberg reductions modulo enough primes below 2^31 (each a row of a Spark job) and Chinese
remaindering; one prime more checks the result. As all roots are real, the sign changes of a Taylor shift count the
roots beyond a point exactly, with multiplicity; bisection by that count isolates the largest ones, and bisection by
sign refines them to ``BITS`` bits. A component is the null vector of M - root, by inverse iteration on one LU
factorisation in ``DIGITS`` decimal digits, rounded to doubles at the end.

The driver holds d^2 integers, never vectors; the cost beyond the scan grows with d^3 and the primes with d log n
(d = 64: under 150 primes), so the method is for embeddings of up to some hundred dimensions.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; a vector shorter than the
longest is filled up with zeros (an empty one is all zeros); products beyond a long saturate, as ``floor`` does; null
vec_ids and repeated rows are rows like others, and equal vectors count once in the fit; components with eigenvalue 0
cannot be whitened and are left out, so one distinct vector, or an empty table, gives no rows; roots that agree in
``BITS`` bits count as one eigenvalue and get an orthonormal basis of their common space; the entry of largest size of a
component is positive (the first such one); a deviation beyond a long is null, and its digits stand in
``deviation_exact``; further columns of any name are not read.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.sources.scratch import cut, discard

BITS = 160
DIGITS = 110
LIMB = 18  # bits of the parts of x whose products a double matrix product adds up exactly
OUT = 30  # bits of the parts in which exact sums leave a task
ROWS = 1 << 14  # rows of one matrix product: 2 * LIMB + 14 bits stay below 53
PRIMES_A_TASK = 16


@dataclass(frozen=True)
class Whitening:
    """n, the sums, trace of M, the largest eigenvalues of the covariance (with all digits as text) and their components."""

    n: int
    sums: tuple[int, ...]
    trace: int
    roots: tuple[str, ...]  # eigenvalues of M, decimal
    components: np.ndarray  # one row for each

    def eigenvalues(self) -> np.ndarray:
        with decimal.localcontext(prec=DIGITS):
            return np.array([float(Decimal(r) / self.n**2) for r in self.roots])

    def explained(self) -> np.ndarray:
        with decimal.localcontext(prec=DIGITS):
            return np.array([float(Decimal(r) / self.trace) for r in self.roots])


def integer_rows(rows: DataFrame, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``keep`` and x: the remaining rows' entries as longs."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 256).cast("long"))
    return rows.where(F.col("embedding").isNotNull() & whole).select(*keep, x.alias("x"))


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Rows of a list column as one array, filled up with zeros."""
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(lengths) and (lengths == d).all():
        return flat.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.arange(d)[None, :] < lengths[:, None]] = flat
    return out


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Parts of LIMB bits, lowest first; the last one holds the sign."""
    most = int(max(x.max(initial=0), -(x.min(initial=0) + 1)))
    count = max(1, -(-(most.bit_length() + 1) // LIMB))
    low = [((x >> (LIMB * k)) & ((1 << LIMB) - 1)).astype(np.float64) for k in range(count - 1)]
    return [*low, (x >> (LIMB * (count - 1))).astype(np.float64)]


def gram(x: np.ndarray) -> np.ndarray:
    """Exact X'X as Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for first in range(0, len(x), ROWS):
        parts = limbs(x[first : first + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return total


def exact_sums(fit_list: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, S and X'X of the fit list. Tasks send their sums in parts of OUT bits, which Spark adds up as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, sums = 0, np.zeros((d, d), dtype=object), np.zeros(d, dtype=object)
        for batch in batches:
            x = matrix(batch.column("x"), d)
            n += len(x)
            total = total + gram(x)
            sums = sums + sum(((p.sum(axis=0)).astype(np.int64).astype(object) * (1 << (LIMB * k)) for k, p in enumerate(limbs(x))), np.zeros(d, dtype=object))
        cell, part, value = [], [], []
        for c, v in enumerate([n, *sums.tolist(), *total[np.triu_indices(d)].tolist()] if n else []):
            sign, v, k = (-1 if v < 0 else 1), abs(v), 0
            while v:
                cell.append(c), part.append(k), value.append(sign * (v & ((1 << OUT) - 1)))
                v, k = v >> OUT, k + 1
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(value, pa.int64())], names=["cell", "part", "value"])

    added = fit_list.select("x").mapInArrow(run, "cell int, part int, value long").groupBy("cell", "part").agg(F.sum("value").alias("value"))
    cells: dict[int, int] = {}
    for r in added.collect():  # a few for each pair of dimensions, whatever the number of rows
        cells[r.cell] = cells.get(r.cell, 0) + (r.value << (OUT * r.part))
    full = np.zeros((d, d), dtype=object)
    for k, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True)):
        full[i, j] = full[j, i] = cells.get(1 + d + k, 0)
    return cells.get(0, 0), [cells.get(1 + i, 0) for i in range(d)], full


def is_prime(n: int) -> bool:
    """Miller-Rabin with the bases that decide every n below 2^32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return all((x := pow(a, odd, n)) in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1)) for a in (2, 7, 61))


def primes_for(bits: int) -> list[int]:
    """Primes below 2^31 whose product has more than ``bits`` bits, and one more."""
    out, p, have = [], (1 << 31) - 1, 0.0
    while True:
        if is_prime(p):
            out.append(p)
            if have > bits:
                return out
            have += math.log2(p)
        p -= 2


def inverse_mod(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, base, e = np.ones_like(a), a % p, p - 2
    while e.any():
        out = np.where(e & 1, out * base % p, out)
        base, e = base * base % p, e >> 1
    return out


def polynomials_mod(m: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """det(t - M) modulo each prime, lowest coefficient first: Hessenberg form by eliminations, then its recurrence."""
    d, p = len(m), primes.astype(np.int64)
    h = np.stack([(m % int(q)).astype(np.int64) for q in p])
    each, p1, p2 = np.arange(len(p)), p[:, None], p[:, None, None]
    for k in range(1, d - 1):
        pivot = k + np.argmax(h[:, k:, k - 1] != 0, axis=1)  # k itself where the whole column is zero
        h[each, pivot], h[:, k] = h[:, k].copy(), h[each, pivot].copy()
        h[each, :, pivot], h[:, :, k] = h[:, :, k].copy(), h[each, :, pivot].copy()
        u = h[:, k + 1 :, k - 1] * inverse_mod(h[:, k, k - 1], p)[:, None] % p1  # zeros where there is nothing to remove
        h[:, k + 1 :] = (h[:, k + 1 :] - u[:, :, None] * h[:, k, None, :] % p2) % p2
        h[:, :, k] = (h[:, :, k] + (h[:, :, k + 1 :] * u[:, None, :] % p2).sum(axis=2)) % p1
    polys = [np.zeros((len(p), d + 1), np.int64)]
    polys[0][:, 0] = 1
    for k in range(d):
        new = (np.roll(polys[k], 1, axis=1) - h[:, k, k, None] * polys[k] % p1) % p1
        chain = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            new = (new - (h[:, i, k] * chain % p)[:, None] * polys[i] % p1) % p1
        polys.append(new)
    return polys[d]


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """det(t - M) in exact integers, lowest coefficient first; M is symmetric without negative eigenvalues."""
    d, trace = len(m), int(sum(m[i, i] for i in range(len(m))))
    # the absolute coefficients add up to the product of 1 + eigenvalue, at most (1 + trace / d)^d
    primes = primes_for(math.ceil(d * math.log2(2 + trace // d)) + 2)
    rows = m.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(rows, dtype=object)
        for batch in batches:
            q = batch.column("prime").to_numpy()
            for first in range(0, len(q), PRIMES_A_TASK):
                some = q[first : first + PRIMES_A_TASK]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(polynomials_mod(own, some).tolist(), pa.list_(pa.int64()))], names=["prime", "poly"])

    frame = spark.createDataFrame([(q,) for q in primes], "prime long").repartition(max(1, -(-len(primes) // PRIMES_A_TASK)))
    found = {r.prime: r.poly for r in frame.mapInArrow(run, "prime long, poly array<long>").collect()}
    spare, used = primes[-1], primes[:-1]
    product = math.prod(used)
    out = [0] * (d + 1)
    for q in used:
        weight = product // q * pow(product // q, -1, q)
        out = [a + weight * c for a, c in zip(out, found[q], strict=True)]
    out = [v - product if v > product // 2 else v for v in (a % product for a in out)]
    if [v % spare for v in out] != found[spare]:
        raise ArithmeticError("the characteristic polynomial fails its check")
    return out


class RealRoots:
    """Roots of an integer polynomial all of whose roots are real and not negative; points are k / 2^s."""

    def __init__(self, poly: list[int]):
        self.zeros = next(i for i, c in enumerate(poly) if c)
        self.poly = poly[self.zeros :]
        self.degree = len(self.poly) - 1

    def beyond(self, k: int, s: int) -> int:
        """Roots larger than k / 2^s, with multiplicity: sign changes of the polynomial shifted there."""
        c = [v << (s * (self.degree - i)) for i, v in enumerate(self.poly)]
        for i in range(self.degree):
            for j in range(self.degree - 1, i - 1, -1):
                c[j] += k * c[j + 1]
        signs = [v > 0 for v in c if v]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def sign(self, k: int, s: int) -> int:
        v = 0
        for i, c in enumerate(reversed(self.poly)):
            v = v * k + (c << (s * i))
        return (v > 0) - (v < 0)

    def largest(self, count: int, bound: int) -> list[tuple[int, int, int]]:
        """The ``count`` largest roots above zero as (k, s, m): k / 2^s to BITS bits, m roots that agree with it."""
        top = bound.bit_length()
        todo, found = [(0, 1 << top, 0, self.degree, 0)], []  # roots beyond the lower end, beyond the upper end
        while todo and sum(f[2] for f in found) < count:
            lo, hi, s, above_lo, above_hi = todo.pop()
            m = above_lo - above_hi
            if not m:
                continue
            fine = lo.bit_length() > (24 if m == 1 else BITS) and hi - lo == 1
            if fine:
                found.append((*(self.refined(lo, hi, s) if m == 1 else (hi, s)), m))
                continue
            if hi - lo == 1:
                lo, hi, s = 2 * lo, 2 * hi, s + 1
            mid = (lo + hi) // 2
            at = self.beyond(mid, s)
            todo += [(lo, mid, s, above_lo, at), (mid, hi, s, at, above_hi)]  # the upper half is taken first
        return found

    def refined(self, lo: int, hi: int, s: int) -> tuple[int, int]:
        """One simple root in (lo, hi], to BITS bits, by the sign at midpoints."""
        end = self.sign(hi, s)
        while end and lo.bit_length() < BITS:
            lo, hi, s = 2 * lo, 2 * hi, s + 1
            mid = (lo + hi) // 2
            at = self.sign(mid, s)
            if not at:
                return mid, s
            lo, hi = (lo, mid) if at == end else (mid, hi)
        return hi, s


def null_vectors(m: np.ndarray, root: Decimal, count: int) -> list[np.ndarray]:
    """``count`` orthonormal vectors that M - root takes to (nearly) nothing, by inverse iteration on one factorisation."""
    d = len(m)
    as_decimal = np.frompyfunc(Decimal, 1, 1)
    a = as_decimal(m)
    size = max(abs(v) for v in a.flat) or Decimal(1)
    tiny = size.scaleb(-DIGITS + 10)
    for i in range(d):
        a[i, i] -= root
    order = np.arange(d)
    for k in range(d):  # LU with row exchanges, factors kept in place
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        if k + 1 < d:
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for k in range(1, d):
            y[k] -= a[k, :k] @ y[:k]
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] - (a[k, k + 1 :] @ y[k + 1 :] if k + 1 < d else 0)) / a[k, k]
        return y

    out: list[np.ndarray] = []
    for start in range(d + 1):
        if len(out) == count:
            break
        # all ones with a slope at first, then one axis after another: not all are orthogonal to the space
        v = as_decimal(np.array([d + i for i in range(d)] if not start else [int(i == start - 1) for i in range(d)], dtype=object))
        for _ in range(3):
            v = solve(v)
            for u in out:
                v = v - u * (u @ v)
            v = v / (v @ v).sqrt()
        left = as_decimal(m) @ v - v * root
        if (left @ left).sqrt() < size.scaleb(-35):
            out.append(v)
    if len(out) < count:
        raise ArithmeticError("no null vector found")
    return out


def fit(rows: DataFrame, count: int = 4) -> tuple[Whitening | None, DataFrame]:
    """The whitening by the ``count`` largest eigenvalues (None if there is none above 0), and the written fit list."""
    spark = rows.sparkSession
    fit_list = cut(integer_rows(rows, ()).distinct(), "fit-list")
    shape = fit_list.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not shape.most:
        return None, fit_list
    d = shape.most
    if shape.least < d:
        filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x"))).alias("x")
        ragged, fit_list = fit_list, cut(fit_list.select(filled).distinct(), "fit-list")
        discard(ragged)
    n, sums, xx = exact_sums(fit_list, d)
    s = np.array(sums, dtype=object)
    m = n * xx - np.outer(s, s)
    trace = int(sum(m[i, i] for i in range(d)))
    if not trace:
        return None, fit_list
    roots = RealRoots(characteristic_polynomial(spark, m))
    found, vectors = [], []
    with decimal.localcontext(prec=DIGITS):
        for k, bits, multiplicity in roots.largest(min(count, roots.degree), trace):
            root = Decimal(k) / (1 << bits)
            for v in null_vectors(m, root, min(multiplicity, count - len(found))):
                found.append(str(root))
                vectors.append(v.astype(np.float64))
    components = np.array(vectors)
    leading = np.abs(components).argmax(axis=1)
    components *= np.sign(components[np.arange(len(components)), leading])[:, None]
    return Whitening(n, tuple(sums), trace, tuple(found), components), fit_list


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id (null where ``rows`` has none), deviation, deviation_exact, z (whitened, one entry a component)."""
    d, n, sums = len(model.sums), model.n, model.sums
    scaled = model.components.T / np.sqrt(model.eigenvalues())
    has_id = "vec_id" in rows.columns
    largest = max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), d)
            most = n * int(max(x.max(initial=0), -int(x.min(initial=0)))) + largest
            kind = np.int64 if d * most * most < 1 << 63 else object
            off = x.astype(kind) * n - np.array(sums, dtype=kind)
            deviation = (off * off).sum(axis=1).tolist()
            z = (off / n).astype(np.float64) @ scaled
            fits = [v if v < 1 << 63 else None for v in deviation]
            beyond = [None if v < 1 << 63 else str(v) for v in deviation]
            ids = batch.column("vec_id") if has_id else pa.nulls(len(x), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fits, pa.int64()), pa.array(beyond, pa.string()), lists], names=["vec_id", "deviation", "deviation_exact", "z"])

    ids = [F.col("vec_id").cast("long")] if has_id else []
    return rows.select(*ids, "x").mapInArrow(run, "vec_id long, deviation long, deviation_exact string, z array<double>")


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity; two passes, centred before multiplying."""
    k = len(model.roots)
    z = project(fit_list, model).select(*[F.col("z")[i].alias(f"z{i}") for i in range(k)])
    mean = z.agg(*[F.avg(f"z{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = z.agg(*[F.avg((F.col(f"z{i}") - F.lit(mean[i])) * (F.col(f"z{j}") - F.lit(mean[j]))) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))


def whiten(rows: DataFrame, count: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact, for every remaining row."""
    model, fit_list = fit(rows, count)
    if model is None:
        discard(fit_list)
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(fit_list, model)
    discard(fit_list)
    shares = F.array(*[F.lit(float(v)) for v in model.explained()])
    out = project(integer_rows(rows), model).select("vec_id", "deviation", "deviation_exact", F.posexplode("z").alias("place", "whitened"))
    return out.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )
