"""Embedding whitening with an exact characteristic polynomial.

Vectors become vectors of integers. Their scatter matrix, n times the sum of products less the
product of sums, is integer and exact. Its characteristic polynomial is found modulo many primes, by
reduction to Hessenberg form, and put together by Chinese remaindering; the primes are dealt to
tasks. All its roots are real, so the signs of its coefficients after a shift count the roots above
that shift: bisection isolates the largest ones to any precision. Inverse iteration in long fixed
point finds the null space for each of them. Only sums over the vectors and per-prime coefficients,
whose number depends on the dimension alone, come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlab.session import materialise

SCALE = 256
COMPONENTS = 4
PRECISION = 96  # bits of an eigenvalue
PRIMES_A_TASK = 16
EXACT = 1 << 53  # sums of doubles are exact below


# ---- the vectors


def quantised(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * entry) as long; null for a null vector and for one with a null or non-finite entry."""
    entry = F.col(vector).cast("array<double>")
    finite = F.forall(entry, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(entry, lambda c: F.floor(scale * c).cast("long") + 0))


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a whole vector of the table's most frequent length (the larger of two as frequent),
    with that vector quantised in ``__x``; null, empty, broken and odd ones are left out."""
    rows = vectors.withColumn("__x", quantised(vector)).where("__x is not null and size(__x) > 0")
    sizes = rows.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("__x") == (sizes.d if sizes else 0))


def _matrix(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _limbs(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Whole numbers as (power of two, doubles of at most 2^20): one limb if they are small."""
    out, power = [], 0
    while True:
        if not np.abs(x).max(initial=0) > 1 << 20:
            return [*out, (power, x.astype(np.float64))]
        out.append((power, (x & ((1 << 20) - 1)).astype(np.float64)))
        x, power = x >> 20, power + 20


def products(x: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the rows, as Python integers."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    limbs = _limbs(x)
    for p, a in limbs:
        for q, b in limbs:
            most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1)
            rows = max(1, int(EXACT // most))
            for i in range(0, len(x), rows):  # exact in doubles
                part = (a[i:i + rows].T @ b[i:i + rows]).astype(np.int64).astype(object)
                total = total + part * (1 << (p + q))
    return total


@dataclass
class Sums:
    n: int
    total: list[int]  # per dimension
    scatter: np.ndarray  # of Python integers: n * sum of products - product of sums


def sums(fit: DataFrame, column: str = "x") -> Sums:
    """Exact sums over the rows of ``fit``. A task sends one row per entry of the triangle; entries are
    summed where they meet, so the driver sees one row per entry."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            own = products(x)
            n += len(x)
            fits = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            column_sums = x.sum(axis=0).astype(object) if fits else x.astype(object).sum(axis=0)
            total = column_sums if total is None else total + column_sums
            outer = own if outer is None else outer + own
        if n:
            i, j = np.triu_indices(len(total))
            keys = [(-1, -1), *((-1, k) for k in range(len(total))), *zip(i.tolist(), j.tolist())]
            values = [n, *total, *outer[i, j]]
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0)),
            ], names=["i", "j", "value"])

    parts = fit.select(column).mapInArrow(partial, "i int, j int, value decimal(38,0)")
    found = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    value = {(r.i, r.j): int(r.value) for r in found}
    n = value.get((-1, -1), 0)
    d = max((j for _, j in value), default=-1) + 1
    total = [value[-1, k] for k in range(d)]
    scatter = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            scatter[i, j] = scatter[j, i] = n * value[i, j] - total[i] * total[j]
    return Sums(n, total, scatter)


# ---- the characteristic polynomial


def primes_below(top: int, count: int) -> list[int]:
    """The largest primes below ``top``, falling."""
    small = [p for p in range(2, math.isqrt(top) + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    out: list[int] = []
    high = top
    while len(out) < count:
        low = high - 1_000_000
        sieve = np.ones(high - low, bool)
        for p in small:
            sieve[-low % p::p] = False
        out += (low + np.flatnonzero(sieve))[::-1].tolist()
        high = low
    return out[:count]


def hessenberg_polynomials(matrices: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients (constant first) of det(x - A) modulo each prime; ``matrices``: A modulo each.

    All primes advance together: similarity steps clear each column below its subdiagonal, then the
    polynomials of the leading blocks follow from one another.
    """
    a, p = matrices.copy(), primes.astype(np.int64)
    k, d = len(p), a.shape[1]
    mod, every = p[:, None], np.arange(k)
    for c in range(d - 2):
        below = a[:, c + 1:, c]
        pivot = c + 1 + (below != 0).argmax(axis=1)
        row = a[every, pivot].copy()  # exchange rows and columns
        a[every, pivot] = a[:, c + 1]
        a[:, c + 1] = row
        column = a[every, :, pivot].copy()
        a[every, :, pivot] = a[:, :, c + 1]
        a[:, :, c + 1] = column
        lead = a[:, c + 1, c]
        inverse = np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(lead, p)], np.int64)
        factor = a[:, c + 2:, c] * inverse[:, None] % mod
        a[:, c + 2:] = (a[:, c + 2:] - factor[:, :, None] * a[:, c + 1][:, None, :] % p[:, None, None]) % p[:, None, None]
        back = (a[:, :, c + 2:] * factor[:, None, :] % p[:, None, None]).sum(axis=2)  # the inverse step on columns
        a[:, :, c + 1] = (a[:, :, c + 1] + back) % mod
    blocks = [np.zeros((k, d + 1), np.int64)]
    blocks[0][:, 0] = 1
    for m in range(1, d + 1):
        last = blocks[-1]
        new = np.zeros_like(last)
        new[:, 1:] = last[:, :-1]
        new = (new - a[:, m - 1, m - 1][:, None] * last) % mod
        path = np.ones(k, np.int64)
        for i in range(m - 2, -1, -1):
            path = path * a[:, i + 1, i] % p
            new = (new - (path * a[:, i, m - 1] % p)[:, None] * blocks[i]) % mod
        blocks.append(new)
    return blocks[-1]


def coefficient_bits(matrix: np.ndarray) -> int:
    """Bits of the largest coefficient of det(x - A), for A positive semi-definite: the k-th is at
    most the k-th symmetric function of equal roots with the same trace."""
    d, trace = len(matrix), max(int(matrix.trace()), 1)
    return max(math.ceil(math.log2(math.comb(d, k)) + k * max(0.0, math.log2(trace) - math.log2(d))) for k in range(d + 1)) + 2


def characteristic_polynomial(matrix: np.ndarray, spark) -> list[int]:
    """Integer coefficients, constant first, of det(x - A) for an integer scatter matrix."""
    wanted = coefficient_bits(matrix)
    primes = primes_below(1 << 31, math.ceil((wanted + 2) / 30.9))
    d, flat = len(matrix), [str(v) for v in matrix.ravel()]

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.array([int(v) for v in flat], object)
        for batch in batches:
            own = batch["prime"].to_numpy()
            residues = np.stack([(whole % int(q)).astype(np.int64).reshape(d, d) for q in own])
            found = hessenberg_polynomials(residues, own)
            yield pd.DataFrame({"prime": own, "coefficients": list(found)})

    dealt = spark.createDataFrame([(q,) for q in primes], "prime long").repartition(-(-len(primes) // PRIMES_A_TASK))
    rows = dealt.mapInPandas(reduced, "prime long, coefficients array<long>").collect()
    product, value = 1, [0] * (d + 1)
    for row in sorted(rows, key=lambda r: -r.prime):
        q = row.prime
        inverse = pow(product % q, -1, q)
        value = [v + product * ((c - v) * inverse % q) for v, c in zip(value, row.coefficients, strict=True)]
        product *= q
    return [v - product if v > product // 2 else v for v in value]


# ---- roots


def roots_above(polynomial: list[int], at: int, bits: int) -> int:
    """Number of roots greater than ``at / 2^bits``, multiples included, if all roots are real: the
    changes of sign among the coefficients after moving that point to zero."""
    d = len(polynomial) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(polynomial)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(polynomial: list[int], trace: int, count: int, precision: int = PRECISION) -> list[tuple[int, int]]:
    """The ``count`` largest roots, falling, multiples one by one, as (numerator, bits of the
    denominator), to ``precision`` bits below the trace. Roots are between 0 and the trace."""
    bits = max(0, precision - trace.bit_length())
    d = len(polynomial) - 1
    scaled = [v << (bits * (d - k)) for k, v in enumerate(polynomial)]

    def sign(at: int) -> int:
        value = 0
        for c in reversed(scaled):
            value = value * at + c
        return (value > 0) - (value < 0)

    out = []
    for nth in range(1, min(count, d) + 1):
        low, high = -1, (trace + 1) << bits  # more than, not more than, nth - 1 roots above
        above_low, above_high = d, 0
        while high - low > 1 and (above_low, above_high) != (nth, nth - 1):
            mid = (low + high) // 2
            above = roots_above(polynomial, mid, bits)
            if above >= nth:
                low, above_low = mid, above
            else:
                high, above_high = mid, above
        side = sign(high)
        while high - low > 1 and side:  # one root in between: the sign tells where
            mid = (low + high) // 2
            if sign(mid) in (side, 0):
                high = mid
            else:
                low = mid
        out.append((max(high, 0), bits))
    return out


# ---- components


def _solve(matrix: np.ndarray, rhs: np.ndarray, unit: int) -> np.ndarray:
    """Fixed-point solution by elimination with row exchange; a zero pivot becomes the least number."""
    a, b, d = matrix.copy(), rhs.copy(), len(rhs)
    for c in range(d):
        lead = c + max(range(d - c), key=lambda r: abs(a[c + r, c]))
        if lead != c:
            a[[c, lead]], b[[c, lead]] = a[[lead, c]], b[[lead, c]]
        if a[c, c] == 0:
            a[c, c] = 1
        factor = np.array([(v * unit) // a[c, c] for v in a[c + 1:, c]], object)
        if len(factor):
            a[c + 1:, c:] -= np.outer(factor, a[c, c:]) // unit
            b[c + 1:] -= factor * b[c] // unit
    x = np.zeros(d, object)
    for c in range(d - 1, -1, -1):
        x[c] = ((b[c] - int(np.dot(a[c, c + 1:], x[c + 1:])) // unit) * unit) // a[c, c]
    return x


def _normed(x: np.ndarray, unit: int) -> np.ndarray | None:
    size = math.isqrt(int(np.dot(x, x)))
    return np.array([(v * unit) // size for v in x], object) if size else None


def null_vectors(matrix: np.ndarray, roots: list[tuple[int, int]], bits: int = 320) -> list[np.ndarray]:
    """A unit vector (doubles) for each root, at right angles to those before, by inverse iteration."""
    d, unit, out = len(matrix), 1 << bits, []
    fixed = matrix * unit
    scale = 1 << max(0, int(matrix.trace()).bit_length() - 1)  # entries at most about one
    for nth, (numerator, power) in enumerate(roots):
        shifted = fixed.copy()
        for k in range(d):
            shifted[k, k] -= (numerator * unit) >> power
        shifted = shifted // scale
        x = np.array([unit * (1 + (k * (nth + 7) + nth) % 11) for k in range(d)], object)
        for _ in range(4):
            for other in out:
                x = x - other * (int(np.dot(x, other)) // unit) // unit
            x = _normed(x, unit)
            x = _normed(_solve(shifted, x, unit), unit)
        for other in out:
            x = x - other * (int(np.dot(x, other)) // unit) // unit
        out.append(_normed(x, unit))
    return [np.array([int(v) / unit for v in x]) for x in out]


# ---- whitening


@dataclass
class Whitening:
    n: int
    total: list[int]
    values: list[float]  # eigenvalues of the covariance, falling
    shares: list[float]  # of the trace
    vectors: np.ndarray  # (components, dimension), unit length

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sum, exact: longs where they fit."""
        most = max(self.n * int(np.abs(x).max(initial=0)), max(map(abs, self.total), default=0))
        kind = np.int64 if most < 1 << 61 else object
        return x.astype(kind) * self.n - np.array(self.total, kind)

    def apply(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(deviation, whitened coordinates) of quantised rows; a component without spread gives 0."""
        moved = self.centred(x)
        if moved.dtype != object and int(np.abs(moved).max(initial=0)) ** 2 * max(x.shape[1], 1) >= 1 << 62:
            squares = (moved.astype(object) ** 2).sum(axis=1)
        else:
            squares = (moved * moved).sum(axis=1)
        spread = np.sqrt(np.array(self.values))
        scaled = self.vectors / (self.n * np.where(spread > 0, spread, 1.0))[:, None]
        return squares.tolist(), np.where(spread > 0, moved.astype(np.float64) @ scaled.T, 0.0)


def fit(vectors: DataFrame, column: str = "x", components: int = COMPONENTS) -> Whitening | None:
    """Whitening from the distinct vectors in ``vectors``; None without any. Components are numbered by
    falling eigenvalue; within equal ones any orthogonal choice."""
    found = sums(vectors, column)
    if not found.n:
        return None
    trace = int(found.scatter.trace())
    d = min(components, len(found.total))
    if not trace:  # all rows equal
        return Whitening(found.n, found.total, [0.0] * d, [0.0] * d, np.eye(len(found.total))[:d])
    polynomial = characteristic_polynomial(found.scatter, vectors.sparkSession)
    roots = largest_roots(polynomial, trace, d)
    square = found.n * found.n
    values = [numerator / ((1 << bits) * square) for numerator, bits in roots]
    shares = [numerator / ((1 << bits) * trace) for numerator, bits in roots]
    # A root below the precision of the search is zero: that component has no spread.
    real = [numerator >> max(0, bits + trace.bit_length() - PRECISION + 16) > 0 for numerator, bits in roots]
    values = [v if ok else 0.0 for v, ok in zip(values, real, strict=True)]
    shares = [v if ok else 0.0 for v, ok in zip(shares, real, strict=True)]
    return Whitening(found.n, found.total, values, shares, np.stack(null_vectors(found.scatter, roots)))


def _projected(model: Whitening, batches: Iterator[pa.RecordBatch], column: int, kept: list[int]) -> Iterator[tuple]:
    """(kept columns, deviations, coordinates) of each batch."""
    for batch in batches:
        if batch.num_rows:
            deviation, white = model.apply(_matrix(batch, column))
            yield [batch.column(i) for i in kept], deviation, white


def identity_error(distinct: DataFrame, model: Whitening, column: str = "x") -> float:
    """Largest difference between the covariance of the whitened fit list and the identity, over the
    components with spread; 0 without any."""
    live = [i for i, v in enumerate(model.values) if v > 0]
    if not live:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, white in _projected(model, batches, 0, []):
            yield pa.RecordBatch.from_arrays([pa.array(white[:, i]) for i in live], names=[f"w{i}" for i in live])

    white = distinct.select(column).mapInArrow(run, ", ".join(f"w{i} double" for i in live))
    pairs = [(i, j) for i in live for j in live if i <= j]
    row = white.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error): for each usable row
    its coordinates on the first components, from 1.

    Rows whose vector is null, empty, holds null or non-finite entries, or has not the table's most
    frequent length are left out. The fit list holds each distinct quantised vector once, so copies
    do not weigh. Repeated rows give repeated results, null ids are kept, an empty table gives no row.
    A component without spread has whitened and explained 0. ``deviation`` is exact, decimal(38,0).
    ``components`` is cut to the dimension; other columns are ignored.
    """
    rows = usable(vectors.select(F.col(vec_id).alias("__id"), vector), vector).select("__id", F.col("__x").alias("x"))
    distinct = materialise(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, "x", components)
    kind = vectors.schema[vec_id].dataType.simpleString()
    out = (
        f"__id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    if model is None:
        return vectors.sparkSession.createDataFrame([], out).withColumnRenamed("__id", vec_id)
    error = identity_error(distinct, model)
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), deviation, white in _projected(model, batches, 1, [0]):
            n = len(deviation)
            at = pa.array(np.repeat(np.arange(n), count))
            yield pa.RecordBatch.from_arrays([
                ids.take(at), pa.array(np.tile(np.arange(1, count + 1), n), pa.int32()),
                pa.array(np.full(n * count, model.n)),
                pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0)).take(at),
                pa.array(white.ravel()), pa.array(np.tile(model.shares, n)), pa.array(np.full(n * count, error)),
            ], names=["__id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out).withColumnRenamed("__id", vec_id)
