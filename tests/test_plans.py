"""Shape of the plans: no Python in the hot path, filters and columns pushed down, no one-task windows."""

import re
import time

import pytest
from pyspark.sql import functions as F

from riskspark.operators import features
from riskspark.plans import catalog
from riskspark.session import CLEANUP, materialise
from riskspark.sources import fixture as fx

LAZY = [
    "quote_features", "claim_features", "vehicle_override_join", "quote_snapshot_rows", "person_dedup", "address_dedup",
    "phone_dedup", "graph_nodes", "graph_edges", "shared_entities", "quality_quotes", "quality_claims", "quality_spine",
    "reason_codes_given_weights", "latest_per_key", "psi", "burst_windows", "burst_sessions", "profile_claims",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_single_partition_window(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert not re.search("PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas", text)
    assert not re.search(r"Window [^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*SinglePartition", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    text = plan(fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in text and "o_totalprice" not in text
    few = plan(features.quote_features(fx.quotes(spark, sf_dir)).select("quote_id", "driver_age"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", few)
    assert schemas and not any("o_orderpriority" in s or "c_mktsegment" in s or "props" in s for s in schemas)


def test_label_filter_drops_other_branches(spark, sf_dir):
    text = plan(catalog.QUERIES["graph_nodes"](spark, sf_dir).where("label = 'Claim'"))
    assert "concat(claimant_" not in text and "Union" not in text


def test_examples_are_limited_before_the_shuffle(spark, sf_dir):
    text = plan(catalog.QUERIES["quality_quotes"](spark, sf_dir))
    assert "WindowGroupLimit" in text


def test_adaptive_execution_splits_a_hot_quote(spark):
    """A third of all claims on one quote: the join is split instead of left to one task."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {key: spark.conf.get(key, None) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        claims = spark.range(0, 30000, 1, 8).selectExpr(
            "concat('C', id) AS claim_id", "if(id % 3 = 0, 'Q0', concat('Q', id)) AS quote_id", "cast(id % 90 AS int) AS policy_inception_days"
        )
        quotes = spark.range(0, 30000, 1, 8).selectExpr(
            "concat('Q', id) AS quote_id", "0.5D AS risk_score_at_issuance", "'gold' AS policy_tier_at_issuance"
        )
        joined = features.claim_features(claims, quotes)
        assert joined.count() == 30000 and joined.where("risk_score_at_issuance IS NULL").isEmpty()
        rows = joined.select("claim_id", "risk_score_at_issuance")
        rows.collect()
        assert "skew=true" in plan(rows)
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_query_bounds_what_a_task_takes(spark, sf_dir):
    """By default 200 partitions share a shuffle of any size, so a task's sort grows with the tables."""
    from riskspark.session import PARTITIONS

    for key in PARTITIONS:
        spark.conf.unset(key)
    catalog.QUERIES["policy_tier"](spark, sf_dir)
    assert {key: spark.conf.get(key) for key in PARTITIONS} == PARTITIONS
    assert int(PARTITIONS["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) > 200


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_shuffle_files_go_with_their_job(spark, sf_dir):
    """F3, F4, F6 to F11: a table once written, its shuffles hold no disk; rows can be taken twice all the same."""
    for key in CLEANUP:
        spark.conf.unset(key)
    rows = catalog.QUERIES["shared_entities"](spark, sf_dir)
    assert {key: spark.conf.get(key) for key in CLEANUP} == CLEANUP
    before = shuffle_files(spark)
    materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows.collect()))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


@pytest.mark.parametrize("name", ["claim_snapshot_rows", "quality_claim_snapshots", "claims_enriched"])
def test_enriched_claims_work_quotes_out_once(spark, sf_dir, monkeypatch, name):
    """F16 to F19, F23: the graph, the claims and the vectors read quotes that were written once."""
    worked_out, plain = [], fx.quotes
    monkeypatch.setattr(fx, "quotes", lambda *given: worked_out.append(name) or plain(*given))
    monkeypatch.setattr(catalog.graph, "graph_features", lambda nodes, edges, hops: nodes.selectExpr(
        "node_id AS claim_id", "0 AS shared_attribute_count", "0 AS graph_hop_distance", "0.0D AS attorney_centrality_score"))
    catalog.QUERIES[name](spark, sf_dir)
    assert len(worked_out) == 1


def test_wide_claims_travel_once_by_claim_and_once_by_quote(spark, sf_dir, monkeypatch):
    """F6 to F9, F11: graph features are written before the wide rows travel, and the vectors find their claims by quote already."""
    written = []
    monkeypatch.setattr(catalog, "materialise", lambda df, purpose: written.append(purpose) or materialise(df, purpose))
    monkeypatch.setattr(catalog.graph, "graph_features", lambda nodes, edges, hops: nodes.where("label = 'Claim'").selectExpr(
        "node_id AS claim_id", "0 AS shared_attribute_count", "0 AS graph_hop_distance", "0.0D AS attorney_centrality_score"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(catalog.QUERIES["claim_snapshot_rows"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert written[-1] == "features"
    # The claims and their features; then the claims, the quotes' context and the underwriting.
    assert len(re.findall(r"Exchange hashpartitioning\(claim_id", text)) == 2 and len(re.findall(r"Exchange hashpartitioning\(quote_id", text)) == 3
