import math

import numpy as np
import pytest

from riskspark.llm import descent
from tests.llm.test_components import brute as components


def brute(rows, threshold):
    links, counts = [], {i: 0 for i, *_ in rows}
    usable = [(i, np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows
              if v is not None and lab is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for k, (i, v, lab) in enumerate(usable):
        for j, w, other in usable[k + 1:]:
            if lab == other and len(v) == len(w) and float(v @ w) >= threshold:
                links.append((i, j))
                counts[i] += 1
                counts[j] += 1
    joined = components(links)
    return {i: (counts[i], joined.get(i, i), joined.get(i, i) == i) for i in counts}


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist(), i % 3) for i in range(400)]
    centres = rng.standard_normal((6, 16))
    for i in range(400, 700):
        centre = centres[0] if i % 2 else centres[i % 6]  # one dense cluster of hundreds
        rows.append((i, (centre + 0.03 * rng.standard_normal(16)).astype(np.float32).tolist(), 1))
    return rows + [(i, rows[5][1], rows[5][2]) for i in range(700, 760)]  # copies


@pytest.mark.parametrize("block", [32, 1024])
def test_all_links_are_found(spark, block):
    rows = vectors()
    found = descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6), block=block).collect()
    assert len(found) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == brute(rows, descent.THRESHOLD)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1),
            (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [1e300, 1e299], 1), (15, [1e-300, 1e-301], 1)]
    schema = "vec_id long, embedding array<double>, label int, grp string, rep string, vector string, id string"
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in [*rows, (None, [1.0, 0.0], 1)]], schema)
    found = descent.near_vectors(df).collect()
    assert len(found) == len(rows) + 1
    rows[13], rows[14] = (14, [1.0, 0.1], 1), (15, [1.0, 0.1], 1)  # the same directions without overflow
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found if r.vec_id is not None} == brute(rows, descent.THRESHOLD)
    assert [(r.n_links, r.component_id) for r in found if r.vec_id is None] == [(0, None)]
    assert descent.near_vectors(df.limit(0)).count() == 0


def test_audit_sees_missing_links(spark):
    rows = vectors(1)
    df = spark.createDataFrame([(f"16:{lab}", i, 1, v) for i, v, lab in rows[:700]], "grp string, rep long, copies long, vector array<float>")
    none = spark.createDataFrame([], "rep long, linked long")
    assert descent.audit(df, none, descent.THRESHOLD) == 0.0


def test_audit_is_not_fooled_by_a_dense_cluster(spark):
    """A thousand vectors that link with each other are all found, lone pairs are not."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, centre + 0.01 * rng.standard_normal(16)) for i in range(1000)]
    for i in range(1000, 1400, 2):
        one = rng.standard_normal(16)
        rows += [(i, one), (i + 1, one + 0.02 * rng.standard_normal(16))]
    df = spark.createDataFrame([("16:1", i, 1, [float(x) for x in v]) for i, v in rows], "grp string, rep long, copies long, vector array<double>")
    cluster_only = spark.createDataFrame([(i, 999) for i in range(1000)], "rep long, linked long")
    assert descent.audit(df, cluster_only, descent.THRESHOLD, 2000) == 0.0
    whole = cluster_only.unionByName(spark.createDataFrame([(i, 1) for i in range(1000, 1400)], "rep long, linked long"))
    assert descent.audit(df, whole, descent.THRESHOLD, 2000) == 1.0


def test_crippled_search_fails_aloud(spark, monkeypatch):
    rows = vectors(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(descent, "TURNS", 1)
    monkeypatch.setattr(descent, "start", lambda points, *_: spark.createDataFrame([], "u long, v long, sim double"))
    with pytest.raises(RuntimeError, match="query vectors"):
        descent.near_vectors(df)


def test_signs_and_projections_follow_the_label():
    sizes = [descent.plan(n, descent.THRESHOLD) for n in (0, 1, 2_000, 20_000, 1_000_000, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == (2, 3) and sizes[4][0] == 18 and sizes[4][1] >= 12
