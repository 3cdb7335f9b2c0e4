import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions.values import correlation
from riskspark.operators import metrics, monitor, ordered

RNG = random.Random(3)
# A third of the rows share one score.
SCORED = [(RNG.random() < 0.3, 0.5 if i % 3 == 0 else round(RNG.random(), 3)) for i in range(600)]


@pytest.fixture(scope="module")
def scored(spark):
    kept = spark.createDataFrame(SCORED, "y boolean, p double").cache()
    yield kept
    kept.unpersist(True)


def test_auc_counts_ties_as_half(scored):
    pos, neg = [p for y, p in SCORED if y], [p for y, p in SCORED if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    row = metrics.auc_gini(scored, "y", "p").first()
    assert row.auc == pytest.approx(wins) and row.gini == pytest.approx(2 * wins - 1)
    assert metrics.auc_gini(scored, "y", "p", bins=1000).first().auc == pytest.approx(wins, abs=1e-3)
    assert metrics.auc_gini(scored.where("y"), "y", "p").first().auc is None


def test_quantiles_interpolate(spark, scored):
    wanted = {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}
    row = ordered.exact_quantiles(scored, "p", wanted).first()
    for name, q in wanted.items():
        assert row[name] == pytest.approx(np.quantile([p for _, p in SCORED], q))
    four = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)] + [(None,)], "v double")
    assert ordered.exact_quantiles(four, "v", {"q": 0.95}).first().q == pytest.approx(3.85)
    same = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert ordered.exact_quantiles(same, "v", {"q": 0.5}).first().q == 2.0
    assert ordered.approximate_quantiles(four, "v", {"q": 0.5}).first().q in (2.0, 3.0)


@pytest.mark.parametrize("range_rows", [ordered.RANGE_ROWS, 20])
def test_running_totals_equal_a_sorted_sum(scored, range_rows):
    got = {r.p: (r.n, r.n_before) for r in ordered.running_totals(scored, "p", {"n": F.count(F.lit(1))}, range_rows=range_rows).collect()}
    before = 0
    for value in sorted(got):
        count = sum(p == value for _, p in SCORED)
        assert got[value] == (count, before)
        before += count


def test_reliability_closes_the_last_bin(spark):
    df = spark.createDataFrame([(False, 0.0), (True, 0.1), (True, 0.95), (True, 1.0)], "y boolean, p double")
    bins = {r.bin_lower: r for r in metrics.reliability_bins(df, "y", "p").collect()}
    assert sorted(bins) == [0.0, 0.1, 0.9] and bins[0.9]["count"] == 2 and bins[0.9].predicted_freq == 0.975
    assert metrics.expected_calibration_error(df, "y", "p").first().ece == pytest.approx((0 + 0.9 + 2 * 0.025) / 4)


def test_losses_and_errors(spark, scored):
    brier = np.mean([(y - p) ** 2 for y, p in SCORED])
    assert metrics.brier(scored, "y", "p").first().brier == pytest.approx(brier)
    clipped = [(y, min(max(p, 1e-15), 1 - 1e-15)) for y, p in SCORED]
    loss = np.mean([-math.log(p if y else 1 - p) for y, p in clipped])
    assert metrics.log_loss(scored, "y", "p").first().log_loss == pytest.approx(loss)
    df = spark.createDataFrame([(100.0, 80.0), (200.0, 260.0)], "a double, p double")
    row = metrics.severity_errors(df, "a", "p").first()
    assert (row.mae_usd, row.mape) == (40.0, 0.25) and row.rmse_usd == pytest.approx(math.sqrt(2000)) and row.rmse_usd >= row.mae_usd
    report = metrics.severity_calibration_report(df, "a", "p").first()
    assert report.mean_predicted_after_usd == pytest.approx(report.mean_actual_usd)
    zero = df.withColumn("p", F.lit(0.0))
    assert metrics.bias_correction(zero, "a", "p").first().bias_correction == 1.0


def test_importance_and_metric_rows(spark):
    gains = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0)], "feature string, gain double")
    assert {r.feature: r.importance_pct for r in metrics.importance_share(gains).collect()} == {"a": 75.0, "b": 25.0, "c": 0.0}
    flat = gains.withColumn("gain", F.lit(0.0))
    assert {r.importance_pct for r in metrics.importance_share(flat).collect()} == {0.0}
    rows = metrics.to_metric_rows(spark.range(1).selectExpr("1 AS x", "2.5 AS y"), "m").collect()
    assert [(r.model, r.metric, r.value) for r in rows] == [("m", "x", 1.0), ("m", "y", 2.5)]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 2.0, 0.0), (None, 2.0, 1.0)], "x double, k double, y double")
    row = df.select(correlation(F.col("x"), F.col("y")).alias("r"), correlation(F.col("k"), F.col("y")).alias("k")).first()
    assert row.r == pytest.approx(-1.0) and row.k is None


def test_constants_stay_constant_across_partitions(spark):
    df = spark.range(0, 10000, 1, 16).selectExpr("0.1D AS k", "cast(id % 7 AS double) AS y")
    assert df.select(correlation(F.col("k"), F.col("y"))).first()[0] is None


@pytest.mark.parametrize("range_rows", [ordered.RANGE_ROWS, 40])
def test_quantiles_of_many_columns_in_one_pass(spark, range_rows):
    rng = random.Random(8)
    rows = [("abc"[i % 3], None if i % 17 == 0 else float("nan") if i % 23 == 0 else rng.choice([1.5, rng.gauss(0, 1)])) for i in range(900)] + [("none", None)]
    wanted = {"q1": 0.1, "q5": 0.5, "q9": 0.9}
    found = ordered.grouped_quantiles(spark.createDataFrame(rows, "f string, v double"), "v", wanted, ["f"], range_rows).collect()
    assert {r.f for r in found} == {"a", "b", "c"}
    for r in found:
        values = [v for f, v in rows if f == r.f and v is not None and v == v]
        for name, q in wanted.items():
            assert r[name] == pytest.approx(np.quantile(values, q))


def test_psi_bins_come_from_the_baseline(spark):
    baseline = spark.range(1000).selectExpr("cast(id AS double) AS a", "if(id % 4 = 0, NULL, cast(id % 2 AS double)) AS b", "cast(NULL AS double) AS c")
    cuts = monitor.baseline_cuts(baseline, ["a", "b", "c"], bins=4)
    assert cuts == {"a": [249.75, 499.5, 749.25], "b": [0.0, 1.0], "c": []}
    same = {r.feature: (r.psi, r.band) for r in monitor.psi(baseline, baseline, cuts).collect()}
    assert all(v == (pytest.approx(0), "stable") for v in same.values())
    moved = {r.feature: r.band for r in monitor.psi(baseline, baseline.withColumn("a", F.col("a") / 3), cuts).collect()}
    assert moved["a"] == "critical" and moved["b"] == "stable"


def test_rank_agreement_shares_ranks_of_ties(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 1.0, rng.random()]), rng.choice([None, float("nan"), rng.random(), 3.0])) for _ in range(300)]
    kept = [(a, b) for a, b in rows if b is not None and b == b]

    def ranks(values):
        return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]

    want = np.corrcoef(ranks([a for a, _ in kept]), ranks([b for _, b in kept]))[0, 1]
    df = spark.createDataFrame(rows, "a double, b double")
    assert metrics.rank_agreement(df, "a", "b").first()[0] == pytest.approx(want)
    assert metrics.rank_agreement(df, "a", "a").first()[0] == pytest.approx(1)
    assert metrics.rank_agreement(df.withColumn("a", F.lit(1.0)), "a", "b").first()[0] is None
