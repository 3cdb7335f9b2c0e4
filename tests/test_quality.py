import pytest
from pyspark.sql import functions as F

from riskspark.operators import features, graph, monitor, quality
from riskspark.sources import fixture as fx
from riskspark.sources.fixture import quotes as fixture_quotes


def by_id(checks):
    return {r.check_id: r for r in checks.collect()}


def test_broken_quotes_are_named(spark, sf_dir):
    good = fixture_quotes(spark, sf_dir)
    bad = good.withColumn("state", F.when(F.col("customer_key") % 10 == 0, "ZZ").otherwise(F.col("state"))).withColumn(
        "credit_score", F.when(F.col("customer_key") % 11 == 0, 900).otherwise(F.col("credit_score"))
    ).withColumn("telematics_crash_match", F.lit(0.5))
    rows = by_id(quality.check_quotes(bad))
    n = bad.where("state = 'ZZ'").count()
    assert (rows["V1"].status, rows["V1"].n_bad) == ("FAIL", n) and rows["V2"].status == "FAIL" and rows["V22"].status == "FAIL"
    ids = [r.quote_id for r in bad.where("state = 'ZZ'").orderBy("quote_id").limit(5).collect()]
    assert rows["V1"].examples.split(",") == ids
    worst = by_id(quality.failures(quality.check_quotes(bad)))
    assert worst["V1"].n_more == n - 5 and "V23_restricted" not in worst
    clean = by_id(quality.check_quotes(good))
    assert clean["V1"].status == "PASS" and clean["V1"].examples is None
    assert by_id(quality.check_quotes(good.drop("claim_occurred")))["V3"].status == "WARN"


def test_signals_skip_what_they_cannot_judge(spark):
    rows = [(f"c{i}", i % 2 == 0, i % 3 == 0, 0.0, 999 if i % 4 == 0 else 2, 7) for i in range(40)]
    claims = spark.createDataFrame(rows, "claim_id string, is_fraud boolean, attorney_present boolean, attorney_centrality_score double, graph_hop_distance int, claimant_count int")
    found = by_id(quality.check_fraud_signals(claims))
    assert found["V24_incurred_loss_usd"].status == "SKIP"
    assert found["V25_claimant_count"].status == "SKIP"  # A constant has no correlation.
    assert found["V24_claimant_count"].status == "FAIL"
    assert found["V28_zero"].status == "WARN" and found["V29_fraud"].status == "FAIL" and found["V29_gap"].status == "WARN"


def test_topology_of_an_empty_graph(spark):
    nodes = spark.createDataFrame([], "node_id string, label string, is_fraud boolean")
    edges = spark.createDataFrame([], "src string, dst string")
    found = by_id(quality.check_graph_topology(nodes, edges))
    assert (found["V12_nodes"].status, found["V12_edge_ends"].status, found["V13"].status) == ("FAIL", "FAIL", "FAIL")
    lone = spark.createDataFrame([("a", "Claimant", True)], nodes.schema)
    assert by_id(quality.check_graph_topology(lone, edges))["V14"].status == "WARN"


def test_snapshot_rules_catch_each_fault(spark, sf_dir):
    vectors = features.quote_features(fixture_quotes(spark, sf_dir))
    good = features.snapshots(vectors, "quote", F.lit("2024-06-30"))
    assert {r.status for r in quality.check_snapshots(good, "quote").collect()} == {"PASS"}
    unmasked = features.snapshots(vectors.withColumn("credit_eligible", F.lit(True)), "quote", F.lit("2024-06-30"))
    assert by_id(quality.check_snapshots(unmasked, "quote"))["V33"].status == "FAIL"
    stale = good.withColumn("feature_store_version", F.lit("v0"))
    assert by_id(quality.check_snapshots(stale, "quote"))["V31"].n_bad == good.count()
    short = features.snapshots(vectors.drop("driver_age"), "quote", F.lit("2024-06-30"))
    assert by_id(quality.check_snapshots(short, "quote"))["V32"].status == "FAIL"
    wild = features.snapshots(vectors.withColumn("driver_age", F.lit(12)).withColumn("geohash_risk_score", F.lit(float("nan"))), "quote", F.lit("2024-06-30"))
    found = by_id(quality.check_snapshots(wild, "quote"))
    assert (found["V35"].status, found["V36"].status) == ("FAIL", "FAIL")
    nameless = good.withColumn("record_id", F.lit(None).cast("string"))
    assert by_id(quality.check_snapshots(nameless, "quote"))["V30"].status == "FAIL"


def test_spine_finds_orphans_and_differences(spark):
    claims = spark.createDataFrame([("c1", "q1", 0.1), ("c2", "q1", 0.2), ("c3", "qx", 0.1)], "claim_id string, quote_id string, risk_score_at_issuance double")
    quotes = spark.createDataFrame([("q1", 0.1)], "quote_id string, risk_score_at_issuance double")
    found = by_id(quality.check_spine(claims, quotes))
    assert (found["V26"].n_bad, found["V26"].examples) == (1, "qx") and (found["V27"].n_bad, found["V27"].examples) == (1, "c2")


def test_presence(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "here"))
    found = quality.check_presence(spark, {"here": str(tmp_path / "here"), "gone": str(tmp_path / "gone")}).collect()
    assert {r.dataset: r.status for r in found} == {"here": "PASS", "gone": "FAIL"}


def test_topology_counts_by_label_and_type(spark):
    nodes = spark.createDataFrame([("c", "Claim", True), ("p", "Claimant", True), ("lone", "Claimant", False)], "node_id string, label string, is_fraud boolean")
    edges = spark.createDataFrame([("p", "c", "FILED")], "src string, dst string, rel_type string")
    found = {r.check_id: (r.status, r.observed) for r in quality.check_graph_topology(nodes, edges).collect()}
    assert found["V12_nodes_Claimant"] == ("INFO", 2.0) and found["V12_nodes_Vehicle"] == ("INFO", 0.0) and found["V12_edges_FILED"] == ("INFO", 1.0)
    assert found["V14"][0] == "WARN" and found["V13"][0] == "WARN"
    empty = {r.check_id: r.status for r in quality.check_graph_topology(nodes.limit(0), edges.limit(0)).collect()}
    assert empty["V12_nodes"] == empty["V12_edge_ends"] == empty["V13"] == "FAIL"


def test_schema_drift_lists_changed_columns(spark):
    old = spark.createDataFrame([], "a int, b string, c double")
    new = spark.createDataFrame([], "a bigint, c double, d date")
    found = {r.column_name: (r.baseline_type, r.current_type) for r in monitor.schema_drift(old, new).collect()}
    assert found == {"a": ("int", "bigint"), "b": ("string", None), "d": (None, "date")}
    assert monitor.schema_drift(old, old).isEmpty()


def test_topology_groups_without_a_sort(spark):
    """marks of fixed width are grouped by hash; a string's maximum would sort every end of every edge."""
    nodes = spark.createDataFrame([("c", "Claim", True), ("p", "Claimant", True)], "node_id string, label string, is_fraud boolean")
    edges = spark.createDataFrame([("p", "c", "FILED")], "src string, dst string, rel_type string")
    plan = quality.check_graph_topology(nodes, edges)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "SortAggregate" in line and "node_id" in line]
