"""Adapter: the star-schema test tables as quotes, claims and contacts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.constants import TELEMATICS_SIGNALS, US_STATES
from riskspark.functions.scoring import policy_tier, rule_risk_score
from riskspark.operators.entities import vehicles
from riskspark.operators.joins import lookup_join

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def parallel(df: DataFrame) -> DataFrame:
    """Spread a table that one small file would leave to one task. Large tables stay as they are."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def _quote_id(order_key: str) -> str:
    return f"concat('Q-', lpad(cast({order_key} AS string), 9, '0'))"


def _state(nation_key: str) -> str:
    return f"element_at(split('{','.join(US_STATES)}', ','), cast({nation_key} + 1 AS int))"


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with orders: history, telematics and how many orders they hold."""
    history = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.expr("count(*) AS n_orders"),
        F.expr("cast(count_if(o_orderstatus = 'F') AS double) / count(*) AS prior_loss_frequency"),
        F.expr("min(o_totalprice) AS min_price"),
    )
    telematics = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.expr("cast(count_if(event_type = 'error') AS double) / count(*) AS telematics_distraction_score"),
        F.expr("cast(count_if(event_type = 'click') AS double) / count(*) AS telematics_hard_brake_rate"),
        F.expr("max(value) / 500.0D AS telematics_crash_match"),
        F.expr("cast(count(*) % 100 AS double) / 100.0D AS telematics_commute_entropy"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return customers.join(history, "c_custkey").join(telematics, "c_custkey", "left")


def quotes(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One quote per order. ``orders`` may be a stream; the customer side stays static."""
    source = (table(spark, sf_dir, "orders") if orders is None else orders).selectExpr(
        "o_custkey AS c_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    profile = customer_profile(spark, sf_dir)
    if source.isStreaming:
        joined = source.join(profile, "c_custkey")
    else:
        joined = lookup_join(parallel(source), profile, "c_custkey", "n_orders", F.col("o_orderkey"), "inner")
    base = joined.selectExpr(
        f"{_quote_id('o_orderkey')} AS quote_id",
        "c_custkey AS customer_key",
        f"{_state('c_nationkey')} AS state",
        "cast(500 + floor((c_acctbal + 1000.0D) * 350.0D / 11000.0D) AS int) AS credit_score",
        "prior_loss_frequency",
        "least(20000.0D, greatest(500.0D, min_price / 20.0D)) AS prior_loss_severity_avg",
        "cast(o_orderkey % 181 AS int) AS insurance_lapse_days",
        "cast(o_orderkey % 51 AS double) / 10.0D AS violation_severity_index",
        "0.5D + cast(c_custkey % 12 AS double) / 2.0D AS household_driver_density",
        "cast(16 + (c_custkey * 7) % 65 AS int) AS driver_age",
        "cast(least((c_custkey * 7) % 65, o_orderkey % 61) AS int) AS years_licensed",
        "cast(12000 + cast(floor(o_totalprice) AS bigint) % 138000 AS double) AS vehicle_msrp",
        "cast(80 + o_orderkey % 421 AS double) AS vehicle_power",
        "cast(o_orderkey % 101 AS double) / 100.0D AS vehicle_adas_score",
        "cast(o_orderkey % 21 AS int) AS vehicle_age_years",
        "0.1D + cast(c_nationkey AS double) / 60.0D AS geohash_risk_score",
        "cast(1000 + (o_orderkey * 37) % 39001 AS double) AS annual_mileage_estimate",
        *TELEMATICS_SIGNALS,
        "c_custkey % 5 = 0 AS telematics_enrolled",
        "o_orderkey % 51 >= 38 AND o_orderstatus <> 'O' AS claim_occurred",
        "o_orderdate AS quoted_at",
    )
    scored = base.withColumn("risk_score_at_issuance", rule_risk_score())
    return scored.withColumn("policy_tier_at_issuance", policy_tier(F.col("risk_score_at_issuance")))


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per (order, line number), with what the line items alone can say."""
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.expr("max(l_returnflag = 'R' AND l_quantity >= 40) AS is_fraud"),
        F.expr("max(l_discount) AS discount"),
        F.expr("min(l_suppkey) AS attorney_key"),
        F.expr("max(l_quantity) AS quantity"),
        F.expr("count(*) AS n_lines"),
        F.expr("max(l_tax) AS tax"),
        F.expr("max(l_partkey) AS max_part"),
        F.expr("min(l_partkey) AS min_part"),
        F.expr("max(l_extendedprice) AS incurred_loss_usd"),
    )
    return grouped.selectExpr(
        "concat('C-', lpad(cast(l_orderkey AS string), 9, '0'), '-', cast(l_linenumber AS string)) AS claim_id",
        f"{_quote_id('l_orderkey')} AS quote_id",
        "is_fraud",
        "discount >= 0.10D AS attorney_present",
        "attorney_key",
        "cast(quantity * 3.0D AS int) AS policy_inception_days",
        "cast(n_lines AS int) AS claimant_count",
        "cast(tax * 100.0D AS int) AS reporting_delay_days",
        "cast(l_linenumber * 3 AS int) AS submission_hour",
        "cast(l_linenumber - 1 AS int) AS prior_claims_count",
        "cast(attorney_key % 6 AS int) AS reported_injury_count",
        "cast(max_part % 101 AS double) / 100.0D AS narrative_inconsistency_score",
        "cast(min_part % 101 AS double) / 100.0D AS narrative_complexity_score",
        "cast(attorney_key % 31 AS double) AS ip_geolocation_delta_miles",
        "CASE WHEN l_linenumber % 4 <> 0 THEN min_part % 5 <> 0 END AS device_fingerprint_match",
        "CASE l_linenumber % 5 WHEN 0 THEN 'mobile' WHEN 1 THEN 'agent_portal' WHEN 2 THEN 'web' WHEN 3 THEN 'broker' END"
        " AS submission_channel",
        "incurred_loss_usd",
    )


def claims(spark: SparkSession, sf_dir: str, quote_rows: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Claims with the context of their quote. ``lines`` are claim lines that know more already."""
    context = (quotes(spark, sf_dir) if quote_rows is None else quote_rows).select(
        "quote_id", "customer_key", "state", *TELEMATICS_SIGNALS, "risk_score_at_issuance", "policy_tier_at_issuance"
    )
    return (claim_lines(spark, sf_dir) if lines is None else lines).join(context, "quote_id")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw contact values of each quote, in several spellings per customer."""
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").join(nations, "c_nationkey")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey AS c_custkey")
    area, last = "cast(200 + c_custkey % 700 AS string)", "lpad(cast(c_custkey % 10000 AS string), 4, '0')"
    return orders.join(customers, "c_custkey").selectExpr(
        f"{_quote_id('o_orderkey')} AS source_id",
        "c_custkey AS customer_key",
        "if(o_orderkey % 2 = 0, concat('  ', upper(c_name)), c_name) AS name_raw",
        "concat_ws('-', cast(1940 + c_custkey % 60 AS string), lpad(cast(1 + c_custkey % 12 AS string), 2, '0'),"
        " lpad(cast(1 + c_custkey % 28 AS string), 2, '0')) AS dob",
        f"{_state('c_nationkey')} AS state",
        f"CASE o_orderkey % 4 WHEN 0 THEN concat('(', {area}, ') 555-', {last}) WHEN 1 THEN concat('1-', {area}, '-555-', {last})"
        f" WHEN 2 THEN concat({area}, '.555.', {last}) ELSE concat('555', {last}) END AS phone_raw",
        "concat(cast(100 + c_custkey AS string), ' ', CASE o_orderkey % 3 WHEN 0 THEN 'Main St' WHEN 1 THEN 'Main St.'"
        " ELSE 'Main Street' END) AS address_line1_raw",
        "if(o_orderkey % 2 = 0, lower(n_name), n_name) AS city_raw",
        "lpad(cast(10000 + c_custkey % 90000 AS string), 5, '0') AS zip_raw",
    )


def claimants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who filed each claim: the policyholder on even lines, a supplier contact on odd ones."""
    lines = claim_lines(spark, sf_dir).select("claim_id", "quote_id", "submission_hour", "attorney_key")
    holder = contacts(spark, sf_dir).selectExpr("source_id AS quote_id", "name_raw", "dob", "state")
    outside = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS attorney_key", "s_name AS other_name",
        "concat_ws('-', cast(1950 + s_suppkey % 40 AS string), lpad(cast(1 + s_suppkey % 12 AS string), 2, '0'),"
        " lpad(cast(1 + s_suppkey % 28 AS string), 2, '0')) AS other_dob",
        f"{_state('s_nationkey')} AS other_state",
    )
    return lines.join(holder, "quote_id").join(outside, "attorney_key").selectExpr(
        "claim_id AS source_id",
        "if(submission_hour % 2 = 0, name_raw, other_name) AS name_raw",
        "if(submission_hour % 2 = 0, dob, other_dob) AS dob",
        "if(submission_hour % 2 = 0, state, other_state) AS state",
    )


def graph_claims(
    spark: SparkSession, sf_dir: str, quote_rows: DataFrame | None = None, resolve: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Claims with the attorney, the vehicle and the customer's contact values, which pass ``resolve`` before they meet the claims."""
    rows = quotes(spark, sf_dir) if quote_rows is None else quote_rows
    context = vehicles(rows, "state").select("quote_id", "state", "vin", "make", "model", "year")
    lines = claim_lines(spark, sf_dir).selectExpr(
        "claim_id", "quote_id", "is_fraud", "if(attorney_present, concat('attorney_', attorney_key), NULL) AS attorney_id"
    )
    contact = contacts(spark, sf_dir).selectExpr(
        "source_id AS quote_id", "phone_raw", "address_line1_raw", "city_raw", "state AS contact_state", "zip_raw"
    )
    return lines.join(context, "quote_id").join(resolve(contact) if resolve else contact, "quote_id", "left")
