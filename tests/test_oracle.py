"""Registered queries beside their SQL twins. ``tools/compare.py`` runs all of them."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

SAMPLE = [
    "quote_features", "claim_features", "quote_snapshot_rows", "vin_decode", "person_bridge", "person_dedup", "address_dedup",
    "graph_edges", "graph_features", "profile_claims", "quality_entities", "auc_gini", "reason_codes_given_weights",
    "hurdle_score_given_params", "ttl_get", "psi", "premium", "burst_windows", "stream_claim_features",
]


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.oracle(sf_dir)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, sf_dir, connection, name):
    line = compare.compare(spark, connection, sf_dir, name)
    assert line.startswith("ok"), line


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "claim_id"
