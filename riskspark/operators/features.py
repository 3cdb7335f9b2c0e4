"""Quote and claim feature vectors, the regulatory mask and the snapshot envelope."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.constants import (
    CREDIT_RESTRICTED_STATES, FEATURE_STORE_VERSION, HOP_SENTINEL, MODEL_FEATURES, TELEMATICS_SIGNALS,
)
from riskspark.functions.scoring import agreed_score
from riskspark.functions.values import optional, real, truthy


def telematics_trio(df: DataFrame) -> dict[str, Column]:
    """The four signals, whether any is present, and whether an enrolled driver has none."""
    signals = {name: optional(df, name, "double") for name in TELEMATICS_SIGNALS}
    available = F.coalesce(*signals.values()).isNotNull()
    enrolled = F.coalesce(optional(df, "telematics_enrolled", "boolean"), F.lit(False))
    return {
        **signals,
        "telematics_available": available,
        "telematics_enrolled_but_missing": enrolled & ~available,
    }


def credit_eligible(state: Column) -> Column:
    """A missing state is not a restricted one."""
    return ~F.upper(F.coalesce(state, F.lit(""))).isin(CREDIT_RESTRICTED_STATES)


def regulatory_mask(df: DataFrame) -> DataFrame:
    """Null the credit score where the state forbids its use, and say so. Never imputed."""
    eligible = credit_eligible(F.col("state"))
    return df.withColumns({"credit_score": F.when(eligible, F.col("credit_score")), "credit_eligible": eligible})


def msrp_power_ratio(msrp: Column, power: Column) -> Column:
    """Price per unit of power; a missing or zero power counts as 1."""
    divisor = F.greatest(F.coalesce(truthy(real(power), 0.0), F.lit(1.0)), F.lit(1.0))
    return F.coalesce(real(msrp), F.lit(0.0)) / divisor


def override_vehicle(quotes: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Replace raw vehicle fields by the resolved vehicle of the quote, where one exists.

    Should a quote have several vehicle rows, the one with the greatest values stands, whatever the input order.
    """
    resolved = vehicles.groupBy("quote_id").agg(
        F.max(F.struct("vin", "msrp", "horsepower", "adas_score", "vehicle_age_years")).alias("_vehicle")
    )
    joined = quotes.drop("vin").join(resolved, "quote_id", "left")
    vehicle = F.col("_vehicle")
    found = vehicle["vin"].isNotNull()

    def resolved_or_raw(field: str, raw: str, dtype: str) -> Column:
        return F.when(found, vehicle[field].cast(dtype)).otherwise(optional(quotes, raw, dtype))

    return joined.withColumns({
        "vehicle_msrp": resolved_or_raw("msrp", "vehicle_msrp", "double"),
        "vehicle_power": resolved_or_raw("horsepower", "vehicle_power", "double"),
        "vehicle_adas_score": resolved_or_raw("adas_score", "vehicle_adas_score", "double"),
        "vehicle_age_years": F.coalesce(
            vehicle["vehicle_age_years"], optional(quotes, "vehicle_age_years", "int")
        ),
        "vin": vehicle["vin"],
    }).drop("_vehicle")


def _number(df: DataFrame, name: str, dtype: str) -> Column:
    return F.coalesce(optional(df, name, dtype), F.lit(0).cast(dtype)).alias(name)


def quote_features(quotes: DataFrame, keep: tuple[str, ...] = ("quote_id",)) -> DataFrame:
    """The quote feature vector, one flat row per quote behind the ``keep`` columns."""
    vector = quotes.select(
        *[F.col(name).alias(f"_keep_{name}") for name in keep],
        optional(quotes, "vin", "string").alias("vin"),
        optional(quotes, "credit_score", "int").alias("credit_score"),
        _number(quotes, "prior_loss_frequency", "double"),
        _number(quotes, "prior_loss_severity_avg", "double"),
        _number(quotes, "insurance_lapse_days", "int"),
        _number(quotes, "violation_severity_index", "double"),
        _number(quotes, "household_driver_density", "double"),
        _number(quotes, "driver_age", "int"),
        _number(quotes, "years_licensed", "int"),
        msrp_power_ratio(optional(quotes, "vehicle_msrp", "double"), optional(quotes, "vehicle_power", "double"))
        .alias("vehicle_msrp_power_ratio"),
        _number(quotes, "vehicle_adas_score", "double"),
        _number(quotes, "vehicle_age_years", "int"),
        _number(quotes, "geohash_risk_score", "double"),
        optional(quotes, "state", "string").alias("state"),
        _number(quotes, "annual_mileage_estimate", "double"),
        optional(quotes, "risk_score_at_issuance", "double").alias("risk_score_at_issuance"),
        optional(quotes, "policy_tier_at_issuance", "string").alias("policy_tier_at_issuance"),
        *[column.alias(name) for name, column in telematics_trio(quotes).items()],
    )
    masked = regulatory_mask(vector).withColumn("state", F.coalesce("state", F.lit("UNKNOWN")))
    ordered = [c for c in masked.columns if not c.startswith("_keep_")]
    return masked.select(*[F.col(f"_keep_{name}").alias(name) for name in keep if name not in ordered], *ordered)


def underwriting_context(quotes: DataFrame) -> DataFrame:
    """What a claim takes from its quote."""
    return quotes.select(
        "quote_id",
        F.col("risk_score_at_issuance").alias("_uw_risk"),
        F.col("policy_tier_at_issuance").alias("_uw_tier"),
        optional(quotes, "telematics_enrolled", "boolean").alias("_uw_enrolled"),
    )


def claim_features(claims: DataFrame, underwriting: DataFrame | None = None) -> DataFrame:
    """The claim feature vector, one flat row per claim behind its ids.

    Missing values take the type's zero, except: one claimant, a matching device fingerprint, and
    channel ``unknown``. The hop sentinel becomes null.
    """
    names = claims.columns
    if underwriting is not None:
        claims = claims.join(underwriting_context(underwriting), "quote_id", "left")
    else:
        claims = claims.withColumns({
            "_uw_risk": F.lit(None).cast("double"),
            "_uw_tier": F.lit(None).cast("string"),
            "_uw_enrolled": F.lit(None).cast("boolean"),
        })
    own_enrolled = F.col("telematics_enrolled") if "telematics_enrolled" in names else F.lit(None).cast("boolean")
    claims = claims.withColumn("telematics_enrolled", F.coalesce(own_enrolled, F.col("_uw_enrolled"), F.lit(False)))
    hop = optional(claims, "graph_hop_distance", "int")
    return claims.select(
        "claim_id",
        "quote_id",
        _number(claims, "policy_inception_days", "int"),
        _number(claims, "prior_claims_count", "int"),
        _number(claims, "reported_injury_count", "int"),
        _number(claims, "reporting_delay_days", "int"),
        F.coalesce(optional(claims, "attorney_present", "boolean"), F.lit(False)).alias("attorney_present"),
        _number(claims, "submission_hour", "int"),
        F.coalesce(truthy(optional(claims, "claimant_count", "int"), 0), F.lit(1)).alias("claimant_count"),
        F.nullif(hop, F.lit(HOP_SENTINEL)).alias("graph_hop_distance"),
        _number(claims, "shared_attribute_count", "int"),
        _number(claims, "attorney_centrality_score", "double"),
        _number(claims, "narrative_inconsistency_score", "double"),
        _number(claims, "narrative_complexity_score", "double"),
        agreed_score(F.col("_uw_risk"), optional(claims, "risk_score_at_issuance", "double"))
        .alias("risk_score_at_issuance"),
        F.coalesce(truthy(F.col("_uw_tier"), ""), optional(claims, "policy_tier_at_issuance", "string"))
        .alias("policy_tier_at_issuance"),
        _number(claims, "ip_geolocation_delta_miles", "double"),
        F.coalesce(optional(claims, "device_fingerprint_match", "boolean"), F.lit(True)).alias("device_fingerprint_match"),
        F.coalesce(optional(claims, "submission_channel", "string"), F.lit("unknown")).alias("submission_channel"),
        *[column.alias(name) for name, column in telematics_trio(claims).items()],
        *([F.col("state").alias("_state")] if "state" in names else []),
    )


def snapshots(vectors: DataFrame, record_type: str, as_of: Column) -> DataFrame:
    """Wrap feature rows in the snapshot envelope. ``record_type`` is ``quote`` or ``claim``."""
    is_quote = record_type == "quote"
    id_column = f"{record_type}_id"
    features = [c for c in vectors.columns if c not in ("quote_id", "claim_id", "_state")]
    state = F.col("state") if is_quote else (F.col("_state") if "_state" in vectors.columns else F.lit(None).cast("string"))
    return vectors.select(
        F.coalesce(F.col(id_column), F.lit(f"{record_type}-unknown")).alias("record_id"),
        F.lit(record_type).alias("record_type"),
        F.col("quote_id"),
        as_of.cast("timestamp").alias("timestamp"),
        F.lit(FEATURE_STORE_VERSION).alias("feature_store_version"),
        F.coalesce(state, F.lit("UNKNOWN")).alias("state"),
        F.lit(is_quote).alias("regulatory_mask_applied"),
        F.struct(*features).alias("features"),
    )


def model_features(quotes: DataFrame, keep: tuple[str, ...] = ("quote_id",)) -> DataFrame:
    """Model inputs: the masked credit score, the ratio, and enrolment as a number.

    Nulls stay null here; each model states how it takes them.
    """
    ratio = msrp_power_ratio(F.col("vehicle_msrp"), F.col("vehicle_power"))
    derived = {
        "credit_score": F.when(credit_eligible(optional(quotes, "state", "string")), F.col("credit_score")),
        "vehicle_msrp_power_ratio": ratio,
        "telematics_enrolled": F.col("telematics_enrolled").cast("int"),
    }
    columns = [real(derived.get(name, F.col(name))).alias(name) for name in MODEL_FEATURES]
    return quotes.select(*keep, *columns)
