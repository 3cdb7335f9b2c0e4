from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(12))
def test_bounds_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(0, 60, rng.integers(1, 10)))
    counts = rng.integers(1, 9, len(lengths))
    for k in (1, 2, 3, 5):
        bounds = packing.best_bounds(lengths, counts, k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1] and set(bounds) <= set(lengths.tolist())
        best = min(padding(lengths, counts, (*c, lengths[-1])) for m in range(min(k, len(lengths))) for c in combinations(lengths[:-1], m))
        assert padding(lengths, counts, bounds) == best
    assert packing.best_bounds(np.array([], int), np.array([], int), 3) == []


def check(rows, budget):
    """Batches fit the budget, are full but for the last of a bucket, and slots count from 0."""
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bound
        batches[r.bucket, r.batch].append(r)
    last = {b: max(n for bucket, n in batches if bucket == b) for b, _ in batches}
    for (bucket, n), own in batches.items():
        capacity = 1 if own[0].bound > budget else budget // max(1, own[0].bound)
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == capacity or n == last[bucket] and len(own) <= capacity
    for b, n in last.items():
        assert {m for bucket, m in batches if bucket == b} == set(range(n + 1))


@pytest.mark.parametrize("cell_rows", [7, 50000])
def test_batches(spark, cell_rows):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.geometric(0.01, 900)] + [5000, 7000, 0, 0]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(5)
    found = packing.pack(docs, budget=1000, buckets=6, cell_rows=cell_rows).collect()
    assert {r.doc_id: r.n_tokens for r in found} == dict(enumerate(sizes)) and len(found) == len(sizes)
    assert len({r.bound for r in found if r.n_tokens <= 1000}) <= 6
    check(found, 1000)


def test_odd_rows(odd, odd_texts, nothing):
    found = packing.pack(odd, budget=64).collect()
    assert len(found) == len(odd_texts)
    assert sorted(r.n_tokens for r in found) == sorted(len((t or "").encode().split()) for _, t in odd_texts)
    check(found, 64)
    given = packing.pack(odd, tokens=F.when(F.col("doc_id") == 1, -5).otherwise(F.col("doc_id"))).collect()
    assert {r.doc_id: r.n_tokens for r in given}[1] == 0
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("hot", ["7", "CAST(NULL AS BIGINT)"])
def test_a_hot_id_is_dealt_over_cells(spark, hot):
    """A third of all rows under one id, or under none: no cell holds more than a small part of them."""
    docs = spark.range(0, 6000, 1, 8).selectExpr(f"if(id % 3 = 0, {hot}, id + 10) AS doc_id", "'one two three' AS text")
    found = packing.pack(docs, budget=30, cell_rows=200)
    rows = found.collect()
    assert len(rows) == 6000 and sum(r.doc_id is None or r.doc_id == 7 for r in rows) == 2000
    check(rows, 30)
    # Places of the hot id spread over the whole bucket.
    places = sorted(r.batch for r in rows if r.doc_id is None or r.doc_id == 7)
    assert max(b - a for a, b in zip(places, places[1:])) < 40 and places[0] < 40 and places[-1] > 560
