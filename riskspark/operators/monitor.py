"""Decision tiers, pricing and drift monitors: specified in the domain's design papers, run as aggregates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.operators import metrics
from riskspark.operators.ordered import grouped_quantiles

# Stability bands.
PSI_WARNING, PSI_CRITICAL = 0.1, 0.25


def decision_tier(score: Column) -> Column:
    """Straight-through, more evidence, special investigation, or payment hold."""
    return (
        F.when(score < 0.25, "stp").when(score < 0.6, "evidence").when(score <= 0.85, "siu")
        .when(score.isNotNull(), "hold")
    )


def baseline_cuts(baseline: DataFrame, features: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Inner bin edges per feature: exact quantiles of all features in one grouped pass, at most bins - 1 numbers each.

    Nulls and not-a-numbers are left out; a feature without any number has no edge.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("value")) for name in features])
    wanted = {f"q{i}": i / bins for i in range(1, bins)}
    rows = grouped_quantiles(baseline.select(F.inline(cells)), "value", wanted, ["feature"]).collect()
    found = {r["feature"]: sorted({r[q] for q in wanted}) for r in rows}
    return {name: found.get(name, []) for name in features}


def psi(baseline: DataFrame, current: DataFrame, cuts: dict[str, list[float]], floor: float = 1e-6) -> DataFrame:
    """Population stability per feature with its band. Empty bins count as ``floor``; nulls are a bin."""

    def shares(df: DataFrame, which: str) -> DataFrame:
        cells = F.array(*[
            F.struct(F.lit(name).alias("feature"), _bin(F.col(name), edges).alias("bin")) for name, edges in cuts.items()
        ])
        return df.select(F.inline(cells)).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")).select(
            "feature", "bin", F.col("n").cast("double").alias(which)
        )

    # A few rows per feature from here on.
    both = shares(baseline, "expected").join(shares(current, "actual"), ["feature", "bin"], "full")
    both = both.na.fill(0.0, ["expected", "actual"])
    totals = both.groupBy("feature").agg(F.sum("expected").alias("n_expected"), F.sum("actual").alias("n_actual"))
    joined = both.join(totals, "feature")
    a = F.greatest(F.col("actual") / F.col("n_actual"), F.lit(floor))
    e = F.greatest(F.col("expected") / F.col("n_expected"), F.lit(floor))
    scored = joined.groupBy("feature").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))
    band = F.when(F.col("psi") < PSI_WARNING, "stable").when(F.col("psi") <= PSI_CRITICAL, "warning").otherwise("critical")
    return scored.withColumn("band", band)


def _bin(value: Column, edges: list[float]) -> Column:
    number = F.lit(0)
    for edge in edges:
        number = number + (value >= edge).cast("int")
    return F.coalesce(number, F.lit(-1))


def premium(scores: DataFrame, rates: DataFrame, key: str = "policy_tier_at_issuance") -> DataFrame:
    """Risk score × base rate × multipliers, from a rates table keyed by tier."""
    return scores.join(rates, key, "left").withColumn(
        "premium",
        F.col("risk_score") * F.col("base_rate") * F.col("profit_load") * F.col("expense_ratio") * F.col("competitive"),
    )


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, null_rate)`` from one pass."""
    one_row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_rate")) for c in columns])
    return one_row.select(F.inline(cells))


def null_spikes(baseline: DataFrame, current: DataFrame, columns: list[str], margin: float = 0.05) -> DataFrame:
    """Features whose null rate rose by more than ``margin``, among all with both rates."""
    before = null_rates(baseline, columns).withColumnRenamed("null_rate", "baseline_rate")
    after = null_rates(current, columns).withColumnRenamed("null_rate", "current_rate")
    return before.join(after, "feature").withColumn("spike", F.col("current_rate") - F.col("baseline_rate") > margin)


def schema_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Columns that appeared, vanished or changed type. Reads schemas only."""
    old, new = dict(baseline.dtypes), dict(current.dtypes)
    rows = [
        (name, old.get(name), new.get(name))
        for name in sorted(old.keys() | new.keys()) if old.get(name) != new.get(name)
    ]
    return baseline.sparkSession.createDataFrame(rows, "column_name string, baseline_type string, current_type string")


def new_categories(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Values of a category column that the baseline never had."""
    return current.select(column).distinct().join(baseline.select(column).distinct(), column, "left_anti")


def freshness(df: DataFrame, timestamp: str, as_of: Column, max_age_seconds: int) -> DataFrame:
    """Rows, newest timestamp and how many rows are older than allowed."""
    age = as_of.cast("timestamp").cast("double") - F.col(timestamp).cast("timestamp").cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.max(timestamp).alias("newest"),
        F.count_if(age > max_age_seconds).alias("n_stale"),
    )


def collision_rate(links: DataFrame, entity: str, *attributes: str) -> DataFrame:
    """Share of entities whose source rows disagree on a normalised attribute: an unexpected merge."""
    variants = links.groupBy(entity).agg(
        *[F.min(c).alias(f"low_{c}") for c in attributes], *[F.max(c).alias(f"high_{c}") for c in attributes]
    )
    differs = F.lit(False)
    for c in attributes:
        differs = differs | ~F.col(f"low_{c}").eqNullSafe(F.col(f"high_{c}"))
    return variants.agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(differs).alias("collisions"),
        F.avg(differs.cast("int")).alias("collision_rate"),
    )


def champion_gate(df: DataFrame, label: str, champion: str, challenger: str, margin: float = 0.02) -> DataFrame:
    """Both Ginis, and whether the challenger leads by at least ``margin``."""
    a = metrics.auc_gini(df, label, champion).select(F.col("gini").alias("champion_gini"))
    b = metrics.auc_gini(df, label, challenger).select("gini").scalar()
    return a.withColumn("challenger_gini", b).withColumn(
        "promote", F.col("challenger_gini") - F.col("champion_gini") >= margin
    )


def importance_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each feature's importance share between two models."""
    joined = before.withColumnRenamed("importance_pct", "before_pct").join(
        after.withColumnRenamed("importance_pct", "after_pct"), "feature", "full"
    ).na.fill(0.0, ["before_pct", "after_pct"])
    return joined.withColumn("change_pct", F.round(F.col("after_pct") - F.col("before_pct"), 2))


def confirmed_labels(labels: DataFrame, confirmed_at: str, as_of: Column, days: int) -> DataFrame:
    """Labels confirmed in the ``days`` days up to ``as_of``: the retraining window."""
    day = F.to_date(confirmed_at)
    return labels.where((day > F.date_sub(as_of, days)) & (day <= as_of))
