from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskspark.operators import features, quality
from riskspark.sources import feature_store as store
from riskspark.sources import tables
from riskspark.sources.fixture import quotes as fixture_quotes

STAMP = datetime(2024, 6, 30)


@pytest.fixture(scope="module")
def snapshots(spark, sf_dir):
    kept = features.snapshots(features.quote_features(fixture_quotes(spark, sf_dir)), "quote", F.lit(STAMP)).cache()
    yield kept
    kept.unpersist(True)


def test_snapshot_round_trip(spark, tmp_path, snapshots):
    path = str(tmp_path / "snapshots")
    store.write_snapshots(snapshots, path, "quote", 0)
    store.write_snapshots(snapshots, path, "quote", 0)
    assert store.read_snapshots(spark, path, "quote").count() == snapshots.count()
    wanted = snapshots.first()
    found = store.read_snapshot(spark, path, wanted.record_id, "quote").collect()
    assert len(found) == 1 and found[0].features == wanted.features
    assert store.read_snapshot(spark, path, "none", "quote").isEmpty()
    assert store.read_snapshot(spark, path, wanted.record_id, "quote", "v0").isEmpty()
    store.write_snapshots(snapshots, path, "quote", 1)
    assert store.read_snapshots(spark, path, "quote").count() == 2 * snapshots.count()


def test_tolerant_json_read(spark, tmp_path, snapshots):
    path = str(tmp_path / "json")
    store.write_snapshots(snapshots.limit(3), path, "quote", 0, "json")
    broken = tmp_path / "json" / "record_type=quote" / "batch_id=0" / "extra.json"
    broken.write_text('{"record_id": "x", "features": {"vin": 1}}\nnot json\n')
    rows = store.read_snapshots_json(spark, path, "quote")
    assert rows.count() == 5 and rows.where(F.col("_corrupt").isNotNull()).count() >= 1
    whole = rows.where("size(missing_envelope) = 0 AND size(missing_features) = 0")
    assert whole.count() == 3
    found = {r.check_id: r for r in quality.check_snapshots(rows, "quote").collect()}
    assert (found["V30"].status, found["V30"].n_bad) == ("FAIL", 2)


def online(spark, *rows):
    return spark.createDataFrame(
        [(k, f, datetime(2024, 1, 1, h), None if e is None else datetime(2024, 1, 1, e)) for k, f, h, e in rows],
        "key string, features string, updated_at timestamp, expires_at timestamp",
    )


def test_online_table(spark, tmp_path):
    path, now = str(tmp_path / "online"), F.lit(datetime(2024, 1, 1, 12))
    store.upsert(online(spark, ("a", "1", 1, None), ("b", "1", 1, 11), ("c", "1", 1, 13), ("a", "0", 0, None)), path, 0)
    store.upsert(online(spark, ("a", "2", 2, None)), path, 1)
    store.upsert(online(spark, ("a", "2", 2, None)), path, 1)
    assert {r.key: r.features for r in store.online_view(spark, path, now).collect()} == {"a": "2", "c": "1"}
    assert store.get(spark, path, "a", now).first().features == "2"
    assert store.get(spark, path, "b", now).isEmpty() and store.get(spark, path, "zz", now).isEmpty()
    store.delete(online(spark, ("a", "", 3, None)), path, 2, F.lit(datetime(2024, 1, 1, 3)))
    assert store.get(spark, path, "a", now).isEmpty()
    store.upsert(online(spark, ("a", "4", 4, None)), path, 3)
    assert store.get(spark, path, "a", now).first().features == "4"
    store.compact(spark, path, str(tmp_path / "compact"), now)
    assert {r.key: r.features for r in store.online_view(spark, str(tmp_path / "compact"), now).collect()} == {"a": "4", "c": "1"}


def test_save_serves_what_it_stores(spark, tmp_path, snapshots):
    store.save(snapshots, str(tmp_path / "off"), str(tmp_path / "on"), 0, "quote", 3600)
    one = snapshots.first()
    live = store.get(spark, str(tmp_path / "on"), one.record_id, F.lit(datetime(2024, 6, 30, 0, 30))).first()
    assert f'"state":"{one.state}"' in live.features and live.expires_at == datetime(2024, 6, 30, 1)
    assert store.get(spark, str(tmp_path / "on"), one.record_id, F.lit(datetime(2024, 6, 30, 1))).isEmpty()


def test_tables_name_the_missing_step_and_refuse_self_overwrite(spark, tmp_path):
    with pytest.raises(tables.MissingUpstreamTable, match="run resolve_entities first"):
        tables.read(spark, str(tmp_path / "none"), upstream="resolve_entities")
    path = str(tmp_path / "t")
    tables.write(spark.range(5), path)
    with pytest.raises(ValueError, match="input of the plan"):
        tables.write(tables.read(spark, path).where("id > 1"), path)
    assert tables.read(spark, path).count() == 5
