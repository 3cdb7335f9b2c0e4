"""Whitening of vectors by their exact covariance.

Components become integers; their scatter is summed exactly in tasks. Only that matrix, whose size depends on the
dimension alone, reaches the driver. There its characteristic polynomial is found exactly: modulo many primes by
reduction to Hessenberg form, then joined by Chinese remainders below a proven bound. As all its roots are real,
Descartes' rule counts the roots above any point exactly, so bisection isolates the eigenvalues with their
multiplicities and to any precision. Inverse iteration in high precision finds the null space of the scatter less an
eigenvalue. Projections are computed by Arrow batches; the covariance of the result is measured over all rows.
"""

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.session import materialise

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Bits behind the point to which a root of the integer polynomial is known.
ROOT_BITS = 64
_SAFE = 2**62


class Model(NamedTuple):
    """``n`` vectors of sums ``sums``; ``values``: eigenvalues of the covariance as fractions, falling; ``vectors``: one
    unit row each; ``trace``: the covariance's."""

    n: int
    sums: list[int]
    values: list[Fraction]
    vectors: np.ndarray
    trace: Fraction


# Exact linear algebra on an integer symmetric matrix.

def primes_below(limit: int) -> Iterator[int]:
    """Primes below ``limit``, falling, by Miller-Rabin with bases that decide all numbers of 32 bits."""
    for p in range(limit - 1 - limit % 2, 2, -2):
        d, r = p - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1

        def passes(base: int) -> bool:
            x = pow(base, d, p)
            return x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(r - 1))

        if all(passes(base) for base in (2, 3, 5, 7) if base < p):
            yield p


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inverses modulo each prime by Fermat's little theorem; zero gives zero."""
    result, power, left = np.ones_like(x), x.copy(), p - 2
    while left.any():
        result = np.where(left & 1, result * power % p, result)
        power, left = power * power % p, left >> 1
    return np.where(x == 0, 0, result)


def hessenberg(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``a[k]`` modulo ``p[k]``, brought to upper Hessenberg form by similarity, all primes side by side."""
    a, d, each = a.copy(), a.shape[1], np.arange(len(p))
    one, two = p[:, None], p[:, None, None]
    for m in range(1, d - 1):
        pivot = m + (a[:, m:, m - 1] != 0).argmax(1)
        a[each, m], a[each, pivot] = a[each, pivot], a[each, m].copy()
        a[each, :, m], a[each, :, pivot] = a[each, :, pivot], a[each, :, m].copy()
        factor = a[:, m + 1:, m - 1] * _inverse(a[:, m, m - 1], p)[:, None] % one
        a[:, m + 1:] = (a[:, m + 1:] - factor[:, :, None] * a[:, m, None] % two) % two
        for i in range(factor.shape[1]):
            a[:, :, m] = (a[:, :, m] + a[:, :, m + 1 + i] * factor[:, i, None]) % one
    return a


def modular_polynomials(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients, constant first, of every det(x - a[k]) modulo p[k]."""
    h, d, one = hessenberg(a, p), a.shape[1], p[:, None]
    polys = np.zeros((d + 1, len(p), d + 1), np.int64)
    polys[0, :, 0] = 1
    for k in range(1, d + 1):
        last = polys[k - 1]
        polys[k, :, 1:] = last[:, :-1]
        polys[k] = (polys[k] - h[:, k - 1, k - 1, None] * last % one) % one
        product = np.ones(len(p), np.int64)
        for i in range(1, k):
            product = product * h[:, k - i, k - i - 1] % p
            polys[k] = (polys[k] - (h[:, k - i - 1, k - 1] * product % p)[:, None] * polys[k - i - 1] % one) % one
    return polys[d]


def characteristic_polynomial(matrix: list[list[int]], trace: int) -> list[int]:
    """Coefficients of det(x - matrix), constant first, for a positive semidefinite integer matrix of this trace.

    The k-th elementary symmetric function of roots that are not negative and sum to t is at most C(d, k) (t/d)^k.
    """
    d = len(matrix)
    bound = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    chosen, product = [], 1
    for prime in primes_below(2**31):
        chosen.append(prime)
        product *= prime
        if product > 2 * bound:
            break
    found: list[int] = [0] * (d + 1)
    for start in range(0, len(chosen), 64):
        block = chosen[start:start + 64]
        p = np.array(block, np.int64)
        residues = np.array([[[int(x % q) for x in row] for row in matrix] for q in block], np.int64)
        for q, polynomial in zip(block, modular_polynomials(residues, p).tolist()):
            other = product // q
            weight = other * pow(other, -1, q)
            found = [x + c * weight for x, c in zip(found, polynomial)]
    return [x - product if (x := c % product) > product // 2 else x for c in found]


def roots_above(polynomial: list[int], point: int) -> int:
    """How many roots, with multiplicity, lie above ``point``: the sign changes after a shift, exact as all roots are real."""
    c = list(polynomial)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += point * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], most: int, bound: int, bits: int = ROOT_BITS) -> list[tuple[Fraction, int]]:
    """The positive roots among the ``most`` largest, falling, as (value, multiplicity); none exceeds ``bound``.

    A value lies above the middle of its interval by half of 2 ** -bits at most. Roots within one interval count as one.
    """
    d = len(polynomial) - 1
    scaled = [c << (bits * (d - i)) for i, c in enumerate(polynomial)]
    counts: dict[int, int] = {0: roots_above(scaled, 0), bound << bits: 0}

    def above(point: int) -> int:
        if point not in counts:
            counts[point] = roots_above(scaled, point)
        return counts[point]

    found, wanted = [], min(most, counts[0])
    while (seen := sum(m for _, m in found)) < wanted:
        low = max(point for point, n in counts.items() if n > seen)
        high = min(point for point, n in counts.items() if n <= seen)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle) > seen else (low, middle)
        found.append((Fraction(2 * high - 1, 2 << bits), above(low) - seen))
    return found


def null_space(matrix: list[list[int]], value: Fraction, rank: int, digits: int) -> list[list[Decimal]]:
    """``rank`` orthonormal vectors of the eigenvalue ``value`` by inverse iteration with ``digits`` decimal digits."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = digits
        at = Decimal(value.numerator) / Decimal(value.denominator)
        a = np.array([[Decimal(x) for x in row] for row in matrix], object)
        a[range(d), range(d)] -= at
        floor = max(abs(at), Decimal(1)) * Decimal(10) ** (6 - digits)
        swaps = []
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            swaps.append(pivot)
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
            if abs(a[k, k]) < floor:
                a[k, k] = floor
            a[k + 1:, k] /= a[k, k]
            a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])
        found: list[np.ndarray] = []
        for r in range(rank):
            # Any start will do but one that is orthogonal to the space; these differ in every place.
            v = np.array([Decimal(1) + Decimal((i + 1) * (r + 1) * 7919 % 1009) / 1009 for i in range(d)], object)
            for _ in range(4):
                for k, pivot in enumerate(swaps):
                    if pivot != k:
                        v[[k, pivot]] = v[[pivot, k]]
                for k in range(1, d):
                    v[k] -= a[k, :k] @ v[:k]
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (a[k, k + 1:] @ v[k + 1:] if k + 1 < d else 0)) / a[k, k]
                v = v / max(abs(x) for x in v)
                for _ in range(2):
                    for u in found:
                        v = v - (u @ v) * u
                v = v / (v @ v).sqrt()
            found.append(v)
        return [list(v) for v in found]


def eigen(matrix: list[list[int]], components: int) -> tuple[list[Fraction], np.ndarray]:
    """The largest positive eigenvalues of a positive semidefinite integer matrix, falling, and unit eigenvectors as rows."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    values, vectors = [], []
    if trace:
        roots = largest_roots(characteristic_polynomial(matrix, trace), components, trace + 1)
        digits = 60 + 2 * len(str(trace))
        for value, multiplicity in roots:
            for vector in null_space(matrix, value, multiplicity, digits):
                values.append(value)
                vectors.append([float(x) for x in vector])
    return values[:components], np.array(vectors[:components]).reshape(-1, len(matrix))


# Over the rows.

def _finite(column: Column) -> Column:
    return column.isNotNull() & F.forall(column, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))


def integers(vectors: DataFrame, vector_column: str, id_column: str) -> DataFrame:
    """``id``, ``v`` (array of doubles) of the rows whose vector is whole and of the commonest length, the longer on a tie."""
    whole = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where(_finite(F.col("v")))
    common = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.where(F.size("v") == (common.d if common else 0)).where(F.size("v") > 0)


def _exact(batch: pa.RecordBatch) -> np.ndarray:
    """The integers of a batch, one row each, without the shift: 64 bits where they fit, else Python's."""
    values = batch.column("v")
    flat = np.floor(values.flatten().to_numpy(zero_copy_only=False) * SCALE).reshape(len(values), -1)
    if np.abs(flat).max(initial=0) < 2**31:
        return flat.astype(np.int64)
    # Entries that overflow when scaled are scaled as integers.
    exact = [math.floor(Fraction(c) * SCALE) for c in values.flatten().to_pylist()]
    return np.array(exact, object).reshape(flat.shape)


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums and products of the unshifted integers. What tasks return and what the driver gets is a matrix each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _exact(batch)
            x = np.hstack([np.ones((len(x), 1), x.dtype), x])
            if x.dtype != object and int(np.abs(x).max()) ** 2 * len(x) >= _SAFE:
                x = x.astype(object)
            product = (x.T @ x).astype(object)
            total = product if total is None else total + product
        if total is not None:
            i, j = np.triu_indices(len(total))
            # Parts of 18 decimal digits can be added by Spark whatever the numbers' length.
            whole = [int(v) for v in total[i, j]]
            parts = max(len(str(abs(v))) for v in whole) // 18 + 1
            for part in range(parts):
                cut = [(1 if v >= 0 else -1) * (abs(v) // 10 ** (18 * part) % 10**18) for v in whole]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([part] * len(cut), pa.int32()), pa.array(cut, pa.int64())], names=["i", "j", "part", "value"])

    sums = rows.select("v").mapInArrow(run, "i long, j long, part int, value long").groupBy("i", "j", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    cells: dict[tuple[int, int], int] = {}
    for r in sums.collect():
        cells[r.i, r.j] = cells.get((r.i, r.j), 0) + int(r.value) * 10 ** (18 * r.part)
    d = max((j for _, j in cells), default=0)
    full = [[cells.get((min(i, j), max(i, j)), 0) for j in range(d + 1)] for i in range(d + 1)]
    return full[0][0], full[0][1:], [row[1:] for row in full[1:]]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    n, sums, products = scatter(rows)
    if not n:
        return None
    # n squared times the covariance; a shift of all values changes nothing in it.
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(len(sums))] for i in range(len(sums))]
    values, vectors = eigen(matrix, components)
    trace = sum(matrix[i][i] for i in range(len(sums)))
    return Model(n, [s + n * SHIFT for s in sums], [v / n**2 for v in values], vectors, Fraction(trace, n**2))


def project(rows: DataFrame, model: Model) -> DataFrame:
    """``id``, ``deviation``, ``w``: the whitened values, one for each component."""
    n, centre = model.n, np.array([s - model.n * SHIFT for s in model.sums], object)
    lengths = [(Decimal(v.numerator) / Decimal(v.denominator)).sqrt() * n for v in model.values]
    exact = np.array([[Decimal(x) / length for x in axis] for axis, length in zip(model.vectors.tolist(), lengths)], object)
    axes = exact.astype(float)
    least, most = -(2**63), 2**63 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _exact(batch)
            if x.dtype != object and n * int(np.abs(x).max(initial=0)) + max(map(abs, centre)) < _SAFE:
                off = n * x - centre.astype(np.int64)
                w = off.astype(float) @ axes.T
            else:
                off = n * x.astype(object) - centre
                w = np.array([[Decimal(int(c)) for c in row] for row in off], object) @ exact.T
            if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < _SAFE:
                deviation = (off**2).sum(1).tolist()
            else:
                deviation = [sum(int(c) ** 2 for c in row) for row in off]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([v if least <= v <= most else None for v in deviation], pa.int64()),
                pa.array(list(w.astype(float)), pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, w array<double>")


def identity_error(projected: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of ``w`` less the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = projected.select(*(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null, empty, or hold null or non-finite entries are left out, and those of another length than the commonest
    (the longer on a tie). Repeated rows and ids count each; null ids are kept; other columns are ignored. There are only as many
    components as positive eigenvalues: equal vectors, a single one, or no rows give no rows. Components of one eigenvalue are an
    orthonormal choice that is the same for all rows. Integers are exact at any size; a deviation beyond 64 bits is null.
    """
    rows = integers(vectors, vector_column, id_column)
    model = fit(rows, components)
    found = len(model.values) if model else 0
    if not found:
        kind = vectors.schema[id_column].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    projected = materialise(project(rows, model), "whitened")
    error = identity_error(projected, found)
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    long = projected.select(F.col("id").alias(id_column), "deviation", F.posexplode("w").alias("_at", "whitened"))
    return long.select(
        id_column, (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))
