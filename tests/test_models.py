import pytest
from pyspark.sql import functions as F

from riskspark.constants import MODEL_FEATURES
from riskspark.operators import models
from riskspark.sources import fixture as fx

QUICK = {"maxIter": 8, "stepSize": 0.3, "maxDepth": 4}


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    kept = fx.quotes(spark, sf_dir).cache(), fx.claim_lines(spark, sf_dir).cache()
    yield kept
    for df in kept:
        df.unpersist(True)


@pytest.fixture(scope="module")
def frequency(tables):
    return models.train_frequency(tables[0], **QUICK)


@pytest.fixture(scope="module")
def severity(tables):
    return models.train_severity(*tables)


def test_split_is_stable_and_about_80_20(tables):
    train, holdout = models.split(tables[0])
    n, m = train.count(), holdout.count()
    assert n + m == tables[0].count() and 0.75 < n / (n + m) < 0.85
    assert train.join(holdout, "quote_id").isEmpty()


def test_frequency_report(frequency):
    row = frequency.report.first()
    assert 0.8 < row.auc <= 1.0 and row.gini == pytest.approx(2 * row.auc - 1) and row.log_loss > 0
    assert row.train_rows < row.total_positives + row.total_negatives
    shares = {r.feature: r.importance_pct for r in frequency.importance.collect()}
    assert set(shares) == set(MODEL_FEATURES) and abs(sum(shares.values()) - 100) < 0.5
    assert max(shares, key=shares.get) == "violation_severity_index"


def test_severity_report(severity):
    row = severity.report.first()
    assert 0 < row.mae_usd <= row.rmse_usd and row.train_rows < row.total_rows
    assert abs(sum(r.importance_pct for r in severity.importance.collect()) - 100) < 0.5


def test_calibrated_hurdle(tmp_path, tables, frequency, severity):
    quotes, claims = tables
    plain = models.HurdleModel(frequency.model, severity.model)
    assert not plain.calibration.applied
    fitted, report = models.calibrate_frequency(frequency.model, quotes)
    fitted.bias, costs = models.calibrate_severity(severity.model, quotes, claims)
    row, cost = report.first(), costs.first()
    assert 0 <= row.ece_after <= 1 and row.brier_after <= row.brier_before
    assert row.p_claim_mean_after == pytest.approx(row.actual_claim_rate, rel=0.02)
    assert cost.mean_predicted_after_usd == pytest.approx(cost.mean_actual_usd, rel=1e-6)
    scored = models.HurdleModel(frequency.model, severity.model, fitted).score(quotes)
    assert set(scored.columns) == {"quote_id", "p_claim", "e_cost_usd", "risk_score"}
    bad = scored.where(
        "p_claim < 0 OR p_claim > 1 OR e_cost_usd <= 0 OR risk_score < 0 OR abs(risk_score - p_claim * e_cost_usd) > 1e-6"
    )
    assert bad.isEmpty() and scored.count() == quotes.count()
    summary = models.evaluate(models.HurdleModel(frequency.model, severity.model, fitted), quotes).first()
    assert summary.risk_score_p95 >= summary.risk_score_p50 and summary.calibration_applied and -1 <= summary.hurdle_gini <= 1


def test_one_class_cannot_be_calibrated(spark):
    rows = spark.createDataFrame([(1.0, 0.4), (1.0, 0.6)], "claim_occurred double, p double")
    with pytest.raises(ValueError, match="one class"):
        models.fit_platt(rows)


def test_platt_recovers_a_known_map(spark):
    rows = spark.range(4000).selectExpr("(id % 40 + 1) / 42 AS q", "id").selectExpr(
        "q AS p", "CAST(pmod(xxhash64(id), 100000) < 100000 / (1 + exp(-(2 * ln(q / (1 - q)) - 0.5))) AS double) AS claim_occurred"
    )
    a, b = models.fit_platt(rows)
    assert a == pytest.approx(2.0, abs=0.25) and b == pytest.approx(-0.5, abs=0.25)


@pytest.mark.parametrize("top_n", [1, 3, 5])
def test_reason_codes(spark, tables, top_n):
    weights = models.ReasonWeights({c: 0.1 * i for i, c in enumerate(MODEL_FEATURES)}, {c: 1.0 for c in MODEL_FEATURES})
    coded = models.reason_codes(models.frequency_rows(tables[0]), weights, top_n)
    assert coded.select(F.max(F.size("reason_codes"))).first()[0] == top_n
    for row in coded.limit(20).collect():
        sizes = [abs(c.contribution) for c in row.reason_codes]
        assert sizes == sorted(sizes, reverse=True) and all(c.feature in MODEL_FEATURES for c in row.reason_codes)
        assert sum(abs(c.pct) for c in row.reason_codes) <= 100.5


def test_rounds_end_when_validation_stands_still(tables):
    """An unreachable share of improvement ends the fit at once; the validation rows are part of the training rows."""
    row = models.train_frequency(tables[0], maxIter=30, maxDepth=2, validationTol=0.9).report.first()
    assert row.rounds < 30 and 0 < row.validation_rows < row.train_rows


def test_surrogate_follows_the_trees(tables, frequency):
    found = models.surrogate_agreement(frequency.model, tables[0], models.fit_reason_weights(tables[0])).first()[0]
    assert 0.3 < found <= 1


def test_no_table_of_nodes_is_kept_in_a_fit(frequency):
    """at each level such a table doubles the work on a row and is written to memory again."""
    assert not frequency.model.stages[-1].getCacheNodeIds()


def test_claims_of_a_quote_are_one_weighted_row(spark, tables, monkeypatch):
    """the fit sees a quote once, and its coefficients are those of a fit on every claim."""
    quotes, claims = tables
    seen, fit = [], models.GeneralizedLinearRegression.fit
    monkeypatch.setattr(models.GeneralizedLinearRegression, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    fitted = models.train_severity(quotes, claims)
    rows = models.linear_inputs(claims.join(models.model_features(quotes), "quote_id")).where(models.in_training(F.col("quote_id")))
    assert seen == [rows.select("quote_id").distinct().count()] and seen[0] < rows.count() == fitted.report.first().train_rows
    prepared = models.PipelineModel(fitted.model.stages[:-1]).transform(rows)
    plain = models.GeneralizedLinearRegression(
        family="gamma", link="log", featuresCol="scaled", labelCol="incurred_loss_usd", regParam=1e-4, tol=1e-9)
    plain = fit(plain, prepared)
    assert fitted.model.stages[-1].coefficients.toArray() == pytest.approx(plain.coefficients.toArray(), abs=1e-4)
    means = prepared.select(models.vector_to_array("scaled").alias("x")).select(F.posexplode("x")).groupBy("pos").agg(F.avg("col"), F.stddev("col"))
    assert all(abs(m) < 1e-9 and (s == pytest.approx(1) or s == 0) for _, m, s in means.collect())


@pytest.mark.parametrize("cost", [0.0, None])
def test_a_cost_the_family_refuses_is_not_averaged_away(spark, tables, cost):
    quotes, claims = tables
    first = claims.select("quote_id").first()[0]
    bad = spark.createDataFrame([(first, cost)], "quote_id string, incurred_loss_usd double")
    rows = models.severity_rows(quotes, claims.select("quote_id", "incurred_loss_usd").unionAll(bad)).where(F.col("quote_id") == first)
    assert rows.first().mean_cost == 0.0
