"""Model metrics as aggregates over label and score columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.values import clip, correlation
from riskspark.operators.ordered import approximate_quantiles, exact_quantiles, numeric, running_totals
from riskspark.session import materialise

BINS = 10


def _flag(label: str) -> Column:
    return F.col(label).cast("int")


def beside(one_row: DataFrame, other: DataFrame) -> DataFrame:
    """Two one-row tables as one row. ``other`` is one subquery, however many columns it has."""
    values = other.select(F.struct(*other.columns)).scalar()
    return one_row.withColumns({c: values[c] for c in other.columns})


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Class counts of the whole table and the weight that balances them."""
    positives, negatives = F.count_if(_flag(label) == 1), F.count_if(_flag(label) == 0)
    return df.agg(positives.alias("total_positives"), negatives.alias("total_negatives")).withColumn(
        "scale_pos_weight",
        F.when(F.col("total_positives") > 0, F.col("total_negatives").cast("double") / F.col("total_positives")),
    )


def brier(df: DataFrame, label: str, p: str) -> DataFrame:
    return df.agg(F.avg(F.pow(_flag(label) - F.col(p), F.lit(2.0))).alias("brier"))


def log_loss(df: DataFrame, label: str, p: str) -> DataFrame:
    bounded, y = clip(F.col(p), 1e-15, 1 - 1e-15), _flag(label)
    return df.agg(F.avg(-(y * F.ln(bounded) + (1 - y) * F.ln(1.0 - bounded))).alias("log_loss"))


def _bins(df: DataFrame, label: str, p: str) -> DataFrame:
    # The last bin is closed: p = 1.0 belongs to it.
    number = F.least(F.floor(F.col(p) * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    return df.select(number, _flag(label).alias("y"), F.col(p).alias("p")).groupBy("bin").agg(
        F.avg("p").alias("predicted"), F.avg("y").alias("actual"), F.count(F.lit(1)).alias("n")
    )


def reliability_bins(df: DataFrame, label: str, p: str) -> DataFrame:
    """Ten equal-width bins; empty ones are absent."""
    return _bins(df, label, p).select(
        F.round(F.col("bin") / BINS, 2).alias("bin_lower"),
        F.round((F.col("bin") + 1) / BINS, 2).alias("bin_upper"),
        F.round("predicted", 4).alias("predicted_freq"),
        F.round("actual", 4).alias("actual_freq"),
        F.col("n").alias("count"),
    )


def expected_calibration_error(df: DataFrame, label: str, p: str) -> DataFrame:
    gap = F.abs(F.col("actual") - F.col("predicted"))
    return _bins(df, label, p).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def auc_gini(df: DataFrame, label: str, score: str, bins: int | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count half) and Gini, null when a class is missing.

    ``bins`` first rounds scores in [0, 1] down to that many steps, which bounds the rows to order.
    """
    if bins:
        df = df.withColumn(score, F.floor(F.col(score) * bins) / bins)
    ranked = running_totals(df, score, {
        "pos": F.count_if(_flag(label) == 1), "neg": F.count_if(_flag(label) == 0),
    })
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg(F.when(pairs > 0, won / pairs).alias("auc")).withColumn("gini", 2.0 * F.col("auc") - 1.0)


def rank_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rank correlation of two columns (ties share their middle rank) as one row, null where either is constant.

    Ranks come from running totals, so no column is sorted in one task. Rows that lack either value are left out.
    """
    names = ("_left", "_right")
    both = df.select(*[F.col(c).alias(name) for c, name in zip((a, b), names)])
    for column in names:
        both = numeric(both, column)
    both = materialise(both, "pairs")
    for i, column in enumerate(names):
        ranks = running_totals(both.select(column), column, {"n": F.count(F.lit(1))})
        middle = (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(f"_rank_{i}")
        both = both.join(ranks.select(column, middle), column)
    return both.agg(correlation(F.col("_rank_0"), F.col("_rank_1")).alias("rank_agreement"))


def severity_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    miss = F.col(actual) - F.col(predicted)
    return df.agg(
        F.avg(F.abs(miss)).alias("mae_usd"),
        F.sqrt(F.avg(miss * miss)).alias("rmse_usd"),
        F.avg(F.abs(miss / F.nullif(F.col(actual), F.lit(0.0)))).alias("mape"),
    )


def _bias(actual: str, predicted: str) -> Column:
    return F.when(F.avg(predicted) > 0, F.avg(actual) / F.avg(predicted)).otherwise(F.lit(1.0))


def bias_correction(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean actual over mean predicted, 1.0 when nothing positive was predicted."""
    return df.agg(_bias(actual, predicted).alias("bias_correction"))


def severity_calibration_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Errors and means before and after the multiplicative correction."""
    bias = bias_correction(df, actual, predicted).scalar()
    before, after = F.col(predicted), F.col(predicted) * bias

    def miss(p):
        return F.col(actual) - p

    return df.agg(
        _bias(actual, predicted).alias("bias_correction"),
        F.avg(F.abs(miss(before))).alias("mae_before_usd"),
        F.avg(F.abs(miss(after))).alias("mae_after_usd"),
        F.sqrt(F.avg(miss(before) * miss(before))).alias("rmse_before_usd"),
        F.sqrt(F.avg(miss(after) * miss(after))).alias("rmse_after_usd"),
        F.avg(actual).alias("mean_actual_usd"),
        F.avg(before).alias("mean_predicted_before_usd"),
        F.avg(after).alias("mean_predicted_after_usd"),
    )


def score_distribution(df: DataFrame, exact: bool = True) -> DataFrame:
    """Mean, median and 95th percentile of the risk score, mean probability and mean cost."""
    wanted = {"risk_score_p50": 0.5, "risk_score_p95": 0.95}
    quantiles = (exact_quantiles if exact else approximate_quantiles)(df, "risk_score", wanted)
    means = df.agg(
        F.avg("risk_score").alias("risk_score_mean"),
        F.avg("p_claim").alias("p_claim_mean"),
        F.avg("e_cost_usd").alias("e_cost_mean_usd"),
    )
    return beside(means, quantiles)


def importance_share(gains: DataFrame) -> DataFrame:
    """``(feature, gain)`` to percent of all gain, two decimals. All features stay, also at zero."""
    total = gains.agg(F.sum("gain")).scalar()
    share = F.when(total > 0, F.col("gain") / total * 100.0).otherwise(F.lit(0.0))
    return gains.select("feature", F.round(share, 2).alias("importance_pct"))


def to_metric_rows(one_row: DataFrame, model: str) -> DataFrame:
    """A one-row report as ``(model, metric, value)`` rows."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns
    ])
    return one_row.select(F.lit(model).alias("model"), F.inline(pairs))
