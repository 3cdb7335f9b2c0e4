from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.functions.scoring import agreed_score, debias, logit, platt, policy_tier, rule_risk_score
from riskspark.functions.values import nan_to_null, optional
from riskspark.operators import features

QUOTE = dict(
    quote_id="Q-0001", state="CA", credit_score=700, vehicle_msrp=45000.0, vehicle_power=200.0, vehicle_age_years=3,
    annual_mileage_estimate=12000.0, telematics_distraction_score=None, telematics_hard_brake_rate=None,
    telematics_crash_match=None, telematics_commute_entropy=None, telematics_enrolled=True,
)


def quotes(spark, *changes):
    rows = [{**QUOTE, **change} for change in changes]
    fields = [f for f in schemas.QUOTES if f.name in QUOTE]
    return spark.createDataFrame([tuple(r[f.name] for f in fields) for r in rows], schemas.T.StructType(fields))


def claims(spark, *changes):
    base = dict(
        claim_id="C-0001", quote_id="Q-0001", state="TX", policy_inception_days=20, prior_claims_count=1,
        reported_injury_count=0, reporting_delay_days=2, attorney_present=False, submission_hour=14, claimant_count=1,
        graph_hop_distance=None, device_fingerprint_match=True, submission_channel="mobile",
        telematics_distraction_score=None, telematics_hard_brake_rate=None, telematics_crash_match=0.8,
        telematics_commute_entropy=None,
    )
    rows = [{**base, **change} for change in changes]
    fields = [f for f in schemas.CLAIMS if f.name in base]
    return spark.createDataFrame([tuple(r[f.name] for f in fields) for r in rows], schemas.T.StructType(fields))


def test_quote_vector_masks_credit_and_derives_ratio(spark):
    row = features.quote_features(quotes(spark, {})).first()
    assert (row.state, row.credit_score, row.credit_eligible) == ("CA", None, False)
    assert row.vehicle_msrp_power_ratio == 225.0
    assert (row.telematics_available, row.telematics_enrolled_but_missing) == (False, True)
    assert row.prior_loss_frequency == 0.0 and row.driver_age == 0 and row.vin is None


def test_quote_vector_matches_declared_schema(spark):
    vector = features.quote_features(quotes(spark, {})).drop("quote_id")
    assert [(f.name, f.dataType) for f in vector.schema] == [(f.name, f.dataType) for f in schemas.QUOTE_FEATURES]
    claim = features.claim_features(claims(spark, {})).drop("claim_id", "quote_id", "_state")
    assert [(f.name, f.dataType) for f in claim.schema] == [(f.name, f.dataType) for f in schemas.CLAIM_FEATURES]
    assert len(schemas.REQUIRED_QUOTE_FEATURES) == len(schemas.REQUIRED_CLAIM_FEATURES) == 23


@pytest.mark.parametrize("state,kept", [("CA", False), ("ca", False), ("HI", False), ("TX", True), (None, True), ("", True)])
def test_mask_by_state(spark, state, kept):
    row = features.quote_features(quotes(spark, {"state": state})).first()
    assert row.credit_eligible is kept and row.credit_score == (700 if kept else None)
    assert row.state == ("UNKNOWN" if state is None else state)


@pytest.mark.parametrize("power,ratio", [(None, 45000.0), (0.0, 45000.0), (0.5, 45000.0), (float("nan"), 45000.0), (90.0, 500.0)])
def test_ratio_divisor(spark, power, ratio):
    assert features.quote_features(quotes(spark, {"vehicle_power": power})).first().vehicle_msrp_power_ratio == ratio


def test_trio_treats_nan_as_missing(spark):
    nan = float("nan")
    rows = features.quote_features(quotes(
        spark, {"quote_id": "a", "telematics_crash_match": nan}, {"quote_id": "b", "telematics_crash_match": 0.4},
        {"quote_id": "c", "telematics_enrolled": False}, {"quote_id": "d", "telematics_enrolled": None},
    )).orderBy("quote_id").collect()
    assert [(r.telematics_available, r.telematics_enrolled_but_missing) for r in rows] == [
        (False, True), (True, False), (False, False), (False, False)
    ]
    assert rows[0].telematics_crash_match is None


def test_claim_vector_takes_underwriting_values(spark):
    context = spark.createDataFrame(
        [("Q-0001", 0.54, "gold", True)],
        "quote_id string, risk_score_at_issuance double, policy_tier_at_issuance string, telematics_enrolled boolean",
    )
    row = features.claim_features(claims(spark, {}), context).first()
    assert (row.risk_score_at_issuance, row.policy_tier_at_issuance) == (0.54, "gold")
    assert row.telematics_available and row.telematics_crash_match == 0.8 and not row.telematics_enrolled_but_missing
    silent = features.claim_features(claims(spark, {"telematics_crash_match": None}), context).first()
    assert silent.telematics_enrolled_but_missing
    alone = features.claim_features(claims(spark, {"quote_id": "none"}), context).first()
    assert alone.risk_score_at_issuance is None and not alone.telematics_enrolled_but_missing


@pytest.mark.parametrize("hop,out", [(999, None), (0, 0), (6, 6), (None, None)])
def test_hop_sentinel(spark, hop, out):
    assert features.claim_features(claims(spark, {"graph_hop_distance": hop})).first().graph_hop_distance == out


def test_claim_defaults(spark):
    row = features.claim_features(claims(spark, {
        "claimant_count": 0, "device_fingerprint_match": None, "submission_channel": None, "attorney_present": None,
    })).first()
    assert (row.claimant_count, row.device_fingerprint_match, row.submission_channel, row.attorney_present) == (1, True, "unknown", False)
    assert features.claim_features(claims(spark, {"claimant_count": None})).first().claimant_count == 1


def test_tier_edges_and_scores(spark):
    edges = [0.0, 0.2499, 0.25, 0.45, 0.65, 1.0]
    df = spark.createDataFrame([(x,) for x in edges], "s double").select(policy_tier(F.col("s")).alias("t"))
    assert [r.t for r in df.collect()] == ["platinum", "platinum", "gold", "silver", "bronze", "bronze"]
    one = spark.range(1).select(
        agreed_score(F.lit(0.0), F.lit(0.3)).alias("zero"), agreed_score(F.lit(0.7), F.lit(0.3)).alias("own"),
        logit(F.lit(1.0)).alias("top"), platt(F.lit(0.2), F.lit(None).cast("double"), F.lit(1.0)).alias("same"),
        platt(F.lit(0.2), F.lit(1.0), F.lit(0.0)).alias("unit"), debias(F.lit(5.0), F.lit(None).cast("double")).alias("cost"),
    ).first()
    assert (one.zero, one.own, one.same, one.cost) == (0.3, 0.7, 0.2, 5.0)
    assert one.top == pytest.approx(20.72, abs=0.01) and one.unit == pytest.approx(0.2)


def test_rule_score_by_hand(spark):
    df = spark.createDataFrame(
        [(660, 0.5, 4000.0, 60, 1.0, True, None, 250.0), (None, 0.0, 0.0, 0, 0.0, False, None, 100.0), (0, 9.0, 9e9, 999, 9.0, True, 0.1, 300.0)],
        "credit_score int, prior_loss_frequency double, prior_loss_severity_avg double, insurance_lapse_days int,"
        " violation_severity_index double, telematics_enrolled boolean, telematics_distraction_score double, vehicle_power double",
    )
    scores = [r[0] for r in df.select(rule_risk_score()).collect()]
    assert scores[0] == pytest.approx(100 / 300 + 0.175 + 0.07 + 0.1 + 0.036 + 0.12 + 0.08)
    assert scores[1] == 0.0 and scores[2] == 1.0


def test_vehicle_override_only_where_found(spark):
    vehicles = spark.createDataFrame(
        [("V1", "Q-0001", 30000.0, 150.0, 0.9, None)],
        "vin string, quote_id string, msrp double, horsepower double, adas_score double, vehicle_age_years int",
    )
    rows = features.override_vehicle(quotes(spark, {}, {"quote_id": "Q-2"}), vehicles).orderBy("quote_id").collect()
    assert (rows[0].vin, rows[0].vehicle_msrp, rows[0].vehicle_power, rows[0].vehicle_age_years) == ("V1", 30000.0, 150.0, 3)
    assert (rows[1].vin, rows[1].vehicle_msrp, rows[1].vehicle_power) == (None, 45000.0, 200.0)


def test_snapshot_envelope(spark):
    vectors = features.quote_features(quotes(spark, {}, {"quote_id": None}))
    snaps = features.snapshots(vectors, "quote", F.lit(datetime(2024, 6, 30)))
    assert set(schemas.ENVELOPE_KEYS) <= set(snaps.columns)
    assert sorted(r.record_id for r in snaps.collect()) == ["Q-0001", "quote-unknown"]
    row = snaps.first()
    assert row.feature_store_version == "v1.0.0" and row.regulatory_mask_applied and row.features.credit_score is None
    claim = features.snapshots(features.claim_features(claims(spark, {})), "claim", F.lit(datetime(2024, 6, 30))).first()
    assert (claim.state, claim.regulatory_mask_applied, claim.quote_id) == ("TX", False, "Q-0001")


def test_nan_to_null_reaches_nested_fields(spark):
    df = spark.createDataFrame(
        [Row(a=float("nan"), b=Row(c=float("nan"), d=1.0), e=[float("nan"), 2.0])],
        "a double, b struct<c:double,d:double>, e array<double>",
    )
    row = nan_to_null(df).first()
    assert row.a is None and row.b.c is None and row.b.d == 1.0 and row.e == [None, 2.0]


def test_nan_in_a_whole_number_field_is_null(spark):
    df = spark.createDataFrame([(float("nan"), 3.0)], "a double, b double")
    assert tuple(df.select(optional(df, "a", "int"), optional(df, "b", "bigint"), optional(df, "c", "int")).first()) == (None, 3, None)
