import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import whitening
from riskspark.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, w string, v string, id string, n int, component int"


def gram(rng, n, d):
    x = [[rng.randint(-50, 50) for _ in range(d)] for _ in range(n)]
    return [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]


def plain_polynomial(m):
    """Coefficients of det(x - m), constant first, by Faddeev and Le Verrier in fractions."""
    d = len(m)
    found, b = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) + (found[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        found.append(-sum(sum(m[i][t] * b[t][i] for t in range(d)) for i in range(d)) / k)
    return [int(c) for c in reversed(found)]


@pytest.mark.parametrize("n, d", [(1, 1), (3, 2), (9, 5), (4, 7), (20, 9)])
def test_polynomial(n, d):
    rng = random.Random(n * d)
    for m in (gram(rng, n, d), [[0] * d for _ in range(d)], [[7 * (i == j) for j in range(d)] for i in range(d)]):
        assert whitening.characteristic_polynomial(m, sum(m[i][i] for i in range(d))) == plain_polynomial(m)


def test_roots_with_multiplicities():
    roots = [9, 9, 4, 3, 3, 3, 0, 0]
    c = [1]
    for r in roots:
        c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
    found = whitening.largest_roots(c, 5, 26)
    assert [(round(float(v), 12), m) for v, m in found] == [(9, 2), (4, 1), (3, 3)]
    close = [10**12 - 1, -2 * 10**6, 1]  # 10^6 - 1 and 10^6 + 1
    assert [m for _, m in whitening.largest_roots(close, 2, 3 * 10**6)] == [1, 1]


def test_eigenvectors_against_library():
    rng = random.Random(3)
    m = gram(rng, 60, 12)
    values, vectors = whitening.eigen(m, 8)
    e, v = np.linalg.eigh(np.array(m, float))
    assert np.allclose([float(x) for x in values], e[::-1][:8], rtol=1e-12)
    assert np.allclose(np.abs((vectors * v.T[::-1][:8]).sum(1)), 1, atol=1e-12)


def test_eigenvectors_of_equal_and_close_values():
    values, vectors = whitening.eigen([[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 0]], 4)
    assert [float(v) for v in values] == [5, 5, 5]
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-15) and np.allclose(vectors[:, 3], 0, atol=1e-30)
    near = [[10**15, 1], [1, 10**15]]
    values, vectors = whitening.eigen(near, 2)
    assert [v - 10**15 for v in map(round, values)] == [1, -1]
    assert np.allclose(np.abs(vectors), math.sqrt(0.5), atol=1e-15) and vectors[0].prod() > 0 > vectors[1].prod()


def brute(rows, k=8):
    """rows: (id, vector) without unusable ones. Values by id up to sign, deviations and shares."""
    x = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    off = [[n * r[j] - s[j] for j in range(d)] for r in x]
    m = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(m)
    found = min(k, np.linalg.matrix_rank(m, tol=1e-9 * e[-1]))
    w = (np.array([[float(Fraction(c, n)) for c in r] for r in off]) @ v[:, ::-1][:, :found]) / np.sqrt(e[::-1][:found])
    return n, [sum(c * c for c in r) for r in off], w, e[::-1][:found] / e.sum()


def agree(df, rows):
    n, deviations, w, explained = brute(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r.component, []).append(r)
    assert sorted(got) == list(range(1, w.shape[1] + 1))
    for k, part in got.items():
        assert len(part) == len(rows)
        own = sorted((str(i), d, abs(x)) for (i, _), d, x in zip(rows, deviations, w[:, k - 1]))
        its = sorted((str(r.vec_id), r.deviation, abs(r.whitened)) for r in part)
        assert [a[:2] for a in own] == [b[:2] for b in its]
        assert np.allclose([a[2] for a in own], [b[2] for b in its], atol=1e-6)
        sign = [r.whitened * x for r, x in zip(sorted(part, key=lambda r: str(r.vec_id)), [x for _, x in sorted(((str(i), x) for (i, _), x in zip(rows, w[:, k - 1])), key=lambda p: p[0])])]
        assert len({i for i, _ in rows}) < len(rows) or all(s > -1e-9 for s in sign) or all(s < 1e-9 for s in sign)
        assert all(abs(r.explained / explained[k - 1] - 1) < 1e-9 and r.n == n and r.identity_error < 1e-9 for r in part)


def test_whole_table(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    agree(whitening.whiten(vectors.repartition(5)), [(r.vec_id, r.embedding) for r in vectors.collect()])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [math.sin(i), i / 7, -i * i / 50]) for i in range(12)] + [(3, [0.5, 0.25, 9.0]), (None, [1.0, -1.0, 2.0]), (3, [0.5, 0.25, 9.0])]
    bad = [(20, None), (21, [1.0, None, 2.0]), (22, [1.0, nan, 2.0]), (23, [inf, 0.0, 0.0]), (24, []), (25, [1.0, 2.0]), (26, [-inf, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", "y", "z", 5, 6) for i, v in good + bad], SCHEMA).repartition(4)
    single = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding and len(r.embedding) == 3 and all(c is not None and math.isfinite(c) for c in r.embedding)]
    assert len(single) == len(good)
    agree(whitening.whiten(df), single)


def test_huge_entries(spark):
    rows = [(i, [1e300 * i, float(i % 3)]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and all(r.deviation is None and r.identity_error < 1e-4 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]], ids=str)
def test_nothing_to_whiten(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_many_rows_over_many_tasks(spark):
    df = spark.range(30_000, numPartitions=16).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * (k + 1)) * (k + 1) for k in range(10))).alias("embedding"))
    got = whitening.whiten(df).groupBy("component").agg(F.avg("whitened").alias("m"), F.var_pop("whitened").alias("v"), F.count("*").alias("c"), F.first("explained").alias("e"), F.max("identity_error").alias("i")).collect()
    assert len(got) == 8 and all(abs(r.m) < 1e-9 and abs(r.v - 1) < 1e-9 and r.c == 30_000 and r.i < 1e-9 for r in got)
    assert [r.e for r in sorted(got, key=lambda r: r.component)] == sorted((r.e for r in got), reverse=True)
