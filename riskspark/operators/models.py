"""Frequency × severity risk model on Spark ML: train, calibrate, score, explain, evaluate."""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.constants import MODEL_FEATURES, TELEMATICS_SIGNALS
from riskspark.functions.scoring import debias, hurdle, logit, platt
from riskspark.operators import metrics
from riskspark.operators.features import model_features
from riskspark.session import materialise

FREQUENCY_TARGET = "claim_occurred"
SEVERITY_TARGET = "incurred_loss_usd"
NULLABLE = ["credit_score", *TELEMATICS_SIGNALS]
# Outside every nullable feature's domain, so one split isolates the missing cohort.
MISSING = -1.0
TRAIN_PERCENT = 80

# Boosting settings of the frequency model.
BOOSTING = {"maxIter": 400, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
#: Rounds end early once a round lowers the loss on a tenth of the training part by less than this share.
EARLY_STOP = {"validationIndicatorCol": "is_validation", "validationTol": 0.001}
VALIDATION_PERCENT = 10


def in_training(key: Column) -> Column:
    """A stable 80/20 split on the key's hash: independent of row order, equal in every step."""
    bucket = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % 100
    return bucket < TRAIN_PERCENT


def in_validation(key: Column) -> Column:
    """A tenth of the keys, by other digits of the hash than the split's, so it cuts across both parts alike."""
    bucket = F.conv(F.substring(F.sha2(key, 256), 9, 8), 16, 10).cast("bigint") % 100
    return bucket < VALIDATION_PERCENT


def split(df: DataFrame, key: str = "quote_id") -> tuple[DataFrame, DataFrame]:
    return df.where(in_training(F.col(key))), df.where(~in_training(F.col(key)))


def split_report(df: DataFrame, label: str, key: str = "quote_id") -> DataFrame:
    """Rows and positives of both parts: a hash split is only about stratified, so show it."""
    part = F.when(in_training(F.col(key)), "train").otherwise("holdout").alias("part")
    return df.groupBy(part).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).cast("int") == 1).alias("positives")
    )


def indicator(name: str) -> str:
    return f"{name}_is_null"


def tree_inputs(df: DataFrame) -> DataFrame:
    """Trees reject nulls: mark them, then place them outside the feature's domain."""
    marks = {indicator(c): F.col(c).isNull().cast("double") for c in NULLABLE}
    return df.withColumns(marks).na.fill(MISSING, NULLABLE).na.fill(0.0, [c for c in MODEL_FEATURES if c not in NULLABLE])


TREE_COLUMNS = [*MODEL_FEATURES, *[indicator(c) for c in NULLABLE]]


def frequency_rows(quotes: DataFrame) -> DataFrame:
    return model_features(quotes, ("quote_id", F.col(FREQUENCY_TARGET).cast("double").alias(FREQUENCY_TARGET)))


def severity_rows(quotes: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims of each quote with its features; only what was known at underwriting.

    Claims of one quote have one vector of inputs, so a gamma regression needs only their number and mean cost: with the number
    as weight the likelihood is that of the claims. A cost the family refuses (null, not positive) makes the mean one it refuses.
    """
    cost = F.col(SEVERITY_TARGET)
    costs = claims.select("quote_id", cost.cast("double")).groupBy("quote_id").agg(
        F.count(F.lit(1)).cast("double").alias("n_claims"), F.sum(cost).alias("total_cost"),
        F.when(F.every(F.coalesce(cost > 0, F.lit(False))), F.avg(cost)).otherwise(0.0).alias("mean_cost"),
    )
    return costs.join(model_features(quotes), "quote_id")


def holdout_costs(model: PipelineModel, quotes: DataFrame, claims: DataFrame) -> DataFrame:
    """Expected and actual cost of the held-out claims; the expected one is worked out once a quote."""
    _, holdout = split(model_features(quotes))
    expected = predict_cost(model, linear_inputs(holdout)).select("quote_id", "e_cost")
    return claims.select("quote_id", F.col(SEVERITY_TARGET).cast("double")).join(expected, "quote_id").select("e_cost", SEVERITY_TARGET)


def balanced(rows: DataFrame) -> DataFrame:
    """Even partitions for the many passes of a fit, whatever the joins before left behind."""
    return rows.repartition(max(
        rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ))


@dataclass
class Fitted:
    """A fitted model with its metric row and its importance shares."""

    model: PipelineModel
    report: DataFrame
    importance: DataFrame


def _importance(spark, gains: dict[str, float]) -> DataFrame:
    """Fold each null mark into its feature. The table has one row per feature."""
    folded = {name: gains[name] + gains.get(indicator(name), 0.0) for name in MODEL_FEATURES}
    return metrics.importance_share(spark.createDataFrame(list(folded.items()), "feature string, gain double"))


def train_frequency(quotes: DataFrame, **boosting) -> Fitted:
    """P(claim) by boosted trees with balancing weights; metrics come from the held-out part."""
    spark = quotes.sparkSession
    key = F.col("quote_id")
    parts = {"is_training": in_training(key), "is_validation": in_validation(key)}
    # The fit reads the rows several times: what part they belong to is written with them.
    rows = materialise(balanced(tree_inputs(frequency_rows(quotes)).withColumns(parts)), "frequency")
    balance = metrics.class_balance(rows, FREQUENCY_TARGET)
    weight = F.when(F.col(FREQUENCY_TARGET) == 1, balance.select("scale_pos_weight").scalar()).otherwise(F.lit(1.0))
    weighted = rows.withColumn("weight", weight)
    train, holdout = weighted.where("is_training"), weighted.where(~F.col("is_training"))
    stages = [
        VectorAssembler(inputCols=TREE_COLUMNS, outputCol="inputs"),
        # Trees are shallow: a row finds its node by some comparisons at less cost than a table of nodes rewritten at each level.
        GBTClassifier(
            featuresCol="inputs", labelCol=FREQUENCY_TARGET, weightCol="weight",
            checkpointInterval=10, **{**BOOSTING, **EARLY_STOP, **boosting},
        ),
    ]
    model = Pipeline(stages=stages).fit(train)
    gains = dict(zip(TREE_COLUMNS, model.stages[-1].featureImportances.toArray().tolist()))
    scored = materialise(predict_probability(model, holdout).select("p", FREQUENCY_TARGET), "frequency-holdout")
    fitted_on = train.agg(
        F.count(F.lit(1)).alias("train_rows"), F.count_if(F.col(FREQUENCY_TARGET) == 1).alias("train_positives"),
        F.count_if("is_validation").alias("validation_rows"), F.lit(model.stages[-1].getNumTrees).alias("rounds"),
    )
    report = metrics.log_loss(scored, FREQUENCY_TARGET, "p")
    for part in (metrics.auc_gini(scored, FREQUENCY_TARGET, "p"), balance, fitted_on):
        report = metrics.beside(report, part)
    return Fitted(model, report, _importance(spark, gains))


def predict_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    return scored.drop("inputs", "rawPrediction", "probability", "prediction")


LINEAR_COLUMNS = [*[f"{c}_filled" for c in MODEL_FEATURES], *[indicator(c) for c in NULLABLE]]


def linear_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({indicator(c): F.col(c).isNull().cast("double") for c in NULLABLE})


def _linear_stages(rows: DataFrame, weight: str) -> list:
    """Mean fill plus null marks, on a common scale so coefficients compare; a row counts as often as its weight says."""
    n = F.col(weight)
    means = rows.agg(*[(F.sum(F.col(c) * n) / F.sum(F.when(F.col(c).isNotNull(), n))).alias(c) for c in MODEL_FEATURES]).first().asDict()
    if empty := [c for c, mean in means.items() if mean is None]:
        raise ValueError(f"no claim has a value of {', '.join(empty)}")
    filled = {f"{c}_filled": f"coalesce({c}, {means[c]!r}D)" for c in MODEL_FEATURES}
    inputs = {c: filled.get(c, c) for c in LINEAR_COLUMNS}
    centres = rows.agg(*[(F.sum(F.expr(x) * n) / F.sum(n)).alias(c) for c, x in inputs.items()]).first().asDict()
    spreads = rows.agg(*[
        F.sqrt(F.sum(n * (F.expr(x) - centres[c]) ** 2) / F.greatest(F.sum(n) - 1, F.lit(1))).alias(c) for c, x in inputs.items()
    ]).first().asDict()
    scaled = {f"{c}_scaled": f"({x} - {centres[c]!r}D) / {spreads[c]!r}D" if spreads[c] else "0.0D" for c, x in inputs.items()}
    # Column expressions, so rows become vectors only once and at the end.
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(f'{x} AS {c}' for c, x in scaled.items())} FROM __THIS__"),
        VectorAssembler(inputCols=list(scaled), outputCol="scaled"),
    ]


def train_severity(quotes: DataFrame, claims: DataFrame, max_iter: int = 25) -> Fitted:
    """E[cost | claim] by a gamma regression with log link; metrics come from the held-out part."""
    spark = quotes.sparkSession
    rows = materialise(balanced(linear_inputs(severity_rows(quotes, claims))), "severity")
    train, _ = split(rows)
    regression = GeneralizedLinearRegression(
        family="gamma", link="log", featuresCol="scaled", labelCol="mean_cost", weightCol="n_claims", predictionCol="e_cost",
        regParam=1e-4, maxIter=max_iter,
    )
    preparation = PipelineModel(_linear_stages(train, "n_claims"))
    # Written once: every iteration reads the vectors again.
    vectors = materialise(preparation.transform(train).select("scaled", "mean_cost", "n_claims"), "severity-inputs")
    model = PipelineModel([*preparation.stages, regression.fit(vectors)])
    sizes = [abs(v) for v in model.stages[-1].coefficients.toArray().tolist()]
    gains = {name.removesuffix("_filled"): size for name, size in zip(LINEAR_COLUMNS, sizes)}
    scored = materialise(holdout_costs(model, quotes, claims), "severity-holdout")
    sizes = rows.agg(
        F.sum("n_claims").cast("bigint").alias("total_rows"),
        F.sum(F.when(in_training(F.col("quote_id")), F.col("n_claims"))).cast("bigint").alias("train_rows"),
        (F.sum("total_cost") / F.sum("n_claims")).alias("target_mean_usd"),
    )
    report = metrics.beside(metrics.severity_errors(scored, SEVERITY_TARGET, "e_cost"), sizes)
    return Fitted(model, report, _importance(spark, gains))


def predict_cost(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).drop("scaled", *[f"{c}_scaled" for c in LINEAR_COLUMNS])


@dataclass
class Calibration:
    """Platt slope and intercept, and the severity bias; ``None`` leaves scores as they are."""

    a: float | None = None
    b: float | None = None
    bias: float | None = None

    @property
    def applied(self) -> bool:
        return self.a is not None


def fit_platt(scored: DataFrame, label: str = FREQUENCY_TARGET, p: str = "p") -> tuple[float, float]:
    """Slope and intercept of a logistic regression on the logit of ``p``."""
    rows = scored.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(logit(F.col(p)))).alias("x"))
    classes = rows.agg(F.count_distinct("label")).first()[0]
    if classes < 2:
        raise ValueError("the calibration rows hold one class only: use more data")
    fitted = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.0, maxIter=200).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def calibrate_frequency(frequency: PipelineModel, quotes: DataFrame) -> tuple[Calibration, DataFrame]:
    """Platt scaling on the held-out part of the split the model was trained with."""
    _, holdout = split(tree_inputs(frequency_rows(quotes)))
    scored = materialise(predict_probability(frequency, holdout).select("p", FREQUENCY_TARGET), "platt")
    a, b = fit_platt(scored)
    both = scored.withColumn("calibrated", platt(F.col("p"), F.lit(a), F.lit(b)))

    def measure(column: str, suffix: str) -> dict[str, Column]:
        return {
            f"brier_{suffix}": metrics.brier(both, FREQUENCY_TARGET, column).scalar(),
            f"ece_{suffix}": metrics.expected_calibration_error(both, FREQUENCY_TARGET, column).scalar(),
        }

    report = both.agg(
        F.avg("p").alias("p_claim_mean_before"), F.avg("calibrated").alias("p_claim_mean_after"),
        F.avg(FREQUENCY_TARGET).alias("actual_claim_rate"),
    ).withColumns({
        "platt_a": F.lit(a), "platt_b": F.lit(b), **measure("p", "before"), **measure("calibrated", "after"),
    })
    improvement = (F.col("brier_before") - F.col("brier_after")) / F.col("brier_before") * 100.0
    return Calibration(a, b), report.withColumn("brier_improvement_pct", improvement)


def calibrate_severity(severity: PipelineModel, quotes: DataFrame, claims: DataFrame) -> tuple[float, DataFrame]:
    """Multiplicative bias on the held-out part."""
    scored = materialise(holdout_costs(severity, quotes, claims), "bias")
    report = metrics.severity_calibration_report(scored, SEVERITY_TARGET, "e_cost")
    return float(report.first()["bias_correction"]), report


@dataclass
class HurdleModel:
    """Both models with their calibration. The risk score is probability times cost."""

    frequency: PipelineModel
    severity: PipelineModel
    calibration: Calibration = field(default_factory=Calibration)

    def score(self, quotes: DataFrame, keep: tuple = ("quote_id",)) -> DataFrame:
        """``p_claim, e_cost_usd, risk_score`` per quote, in one pass over the rows."""
        names = [c if isinstance(c, str) else quotes.select(c).columns[0] for c in keep]
        rows = model_features(quotes, keep)
        c = self.calibration

        def param(value):
            return F.lit(value).cast("double")

        # The two models want nulls differently: cost first, on rows that still have their nulls.
        costed = predict_cost(self.severity, linear_inputs(rows)).drop(*[indicator(n) for n in NULLABLE])
        scored = predict_probability(self.frequency, tree_inputs(costed))
        p_claim = platt(F.col("p"), param(c.a), param(c.b))
        e_cost = debias(F.col("e_cost"), param(c.bias))
        return scored.select(
            *names, p_claim.alias("p_claim"), e_cost.alias("e_cost_usd"), hurdle(p_claim, e_cost).alias("risk_score")
        )


def apply_hurdle(scored: DataFrame, calibration: Calibration) -> DataFrame:
    """Calibrate and combine raw ``p`` and ``e_cost`` columns."""
    a, b, bias = (F.lit(v).cast("double") for v in (calibration.a, calibration.b, calibration.bias))
    return scored.withColumns({
        "p_claim": platt(F.col("p"), a, b), "e_cost_usd": debias(F.col("e_cost"), bias),
    }).withColumn("risk_score", hurdle(F.col("p_claim"), F.col("e_cost_usd"))).drop("p", "e_cost")


def evaluate(model: HurdleModel, quotes: DataFrame) -> DataFrame:
    """Gini of the risk score on held-out rows and on all, with the score distribution."""
    label = F.col(FREQUENCY_TARGET).cast("int").alias(FREQUENCY_TARGET)
    scored = materialise(model.score(quotes, ("quote_id", label)), "hurdle")
    _, holdout = split(scored)
    report = metrics.score_distribution(scored)
    for name, part in (("hurdle_gini", holdout), ("hurdle_gini_all_rows", scored)):
        gini = metrics.auc_gini(part, FREQUENCY_TARGET, "risk_score").select(F.col("gini").alias(name))
        report = metrics.beside(report, gini)
    return report.withColumn("calibration_applied", F.lit(model.calibration.applied))


@dataclass
class ReasonWeights:
    """Log-odds weight and mean of each model feature."""

    weights: dict[str, float]
    means: dict[str, float]


def fit_reason_weights(quotes: DataFrame) -> ReasonWeights:
    """A logistic surrogate on the model features; nulls sit at the mean and contribute nothing."""
    rows = frequency_rows(quotes)
    train, _ = split(rows)
    filled = [f"{c}_filled" for c in MODEL_FEATURES]
    stages = [
        Imputer(strategy="mean", inputCols=MODEL_FEATURES, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="assembled"),
        LogisticRegression(featuresCol="assembled", labelCol=FREQUENCY_TARGET, standardization=True, regParam=1e-4),
    ]
    model = Pipeline(stages=stages).fit(materialise(train, "surrogate"))
    means = model.stages[0].surrogateDF.first().asDict()
    weights = dict(zip(MODEL_FEATURES, model.stages[-1].coefficients.toArray().tolist()))
    return ReasonWeights(weights, {c: float(means[c]) for c in MODEL_FEATURES})


def surrogate_log_odds(rows: DataFrame, given: ReasonWeights) -> Column:
    """The surrogate's log-odds of a row, up to a constant: the sum of its contributions."""
    parts = [F.coalesce(F.lit(w) * (F.col(name) - float(given.means[name])), F.lit(0.0)) for name, w in given.weights.items()]
    return reduce(lambda a, b: a + b, parts)


def surrogate_agreement(frequency: PipelineModel, quotes: DataFrame, given: ReasonWeights) -> DataFrame:
    """How far the surrogate that explains orders held-out quotes as the trees that score do: their rank correlation."""
    _, holdout = split(frequency_rows(quotes))
    marked = holdout.withColumn("surrogate", surrogate_log_odds(holdout, given))
    return metrics.rank_agreement(predict_probability(frequency, tree_inputs(marked)), "surrogate", "p")


def reason_codes(rows: DataFrame, given: ReasonWeights, top_n: int = 5) -> DataFrame:
    """Top contributions per row, largest absolute share first, signed: positive raises P(claim).

    For a logistic model with independent features ``w (x - mean)`` is the exact Shapley value.
    """
    names = list(given.weights)
    contributions = F.array(*[
        F.coalesce(F.lit(given.weights[name]) * (F.col(name) - float(given.means[name])), F.lit(0.0)) for name in names
    ])
    labels = F.array(*[F.lit(name) for name in names])
    total = F.aggregate("_parts", F.lit(0.0), lambda sum_, part: sum_ + F.abs(part))
    staged = rows.withColumn("_parts", contributions).withColumn("_total", F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0)))
    # Sort keys ascending: the negated size first, then the feature's place in the model.
    codes = F.sort_array(F.transform("_parts", lambda part, place: F.struct(
        (-F.abs(part)).alias("order"), place.alias("place"), labels[place].alias("feature"),
        part.alias("contribution"), F.round(part / F.col("_total") * 100.0, 1).alias("pct"),
    )))
    trimmed = F.transform(F.slice(codes, 1, top_n), lambda code: code.dropFields("order", "place"))
    return staged.withColumn("reason_codes", trimmed).drop("_parts", "_total")
