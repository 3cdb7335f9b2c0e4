from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskspark.operators import features
from riskspark.plans import catalog
from riskspark.sources import feature_store as store
from riskspark.sources import fixture as fx
from riskspark.streaming import bursts, late
from riskspark.streaming import features as live

STAMP = F.lit


def replay(spark, df, path, batches=3):
    """Write ``df`` as several files in order, so the stream reads several micro-batches."""
    df.repartitionByRange(batches, "quoted_at").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch_and_serving_survives_replay(spark, sf_dir, tmp_path):
    quotes = fx.quotes(spark, sf_dir)
    batch = features.quote_features(quotes)
    stream = replay(spark, quotes, str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    live.to_table(live.quote_feature_stream(stream), out, state).awaitTermination()
    got = spark.read.schema(batch.schema).parquet(out)
    assert got.count() == batch.count() and got.exceptAll(batch).isEmpty()

    offline, online = str(tmp_path / "off"), str(tmp_path / "on")
    for attempt in ("first", "again"):  # A fresh checkpoint replays every batch id.
        live.serve(stream, "quote", offline, online, str(tmp_path / attempt), F.lit(datetime(2024, 6, 30)), ttl_seconds=None).awaitTermination()
    assert store.read_snapshots(spark, offline, "quote").count() == quotes.count()
    view = store.online_view(spark, online, F.lit(datetime(2024, 6, 30)))
    assert view.count() == quotes.count()


def test_micro_batches_do_not_grow_with_the_stream(spark, sf_dir, tmp_path, monkeypatch):
    """each micro-batch reads the whole underwriting table, so twenty-four files come in four, not in six; none is lost."""
    plain = fx.claims
    monkeypatch.setattr(fx, "claims", lambda *given: plain(*given).repartition(24))
    monkeypatch.setattr(catalog, "scratch_path", lambda _, purpose: str(tmp_path / purpose))
    got = catalog.QUERIES["stream_claim_features"](spark, sf_dir)
    assert len([f for f in (tmp_path / "stream-state" / "commits").iterdir() if f.name.isdigit()]) == 4
    wanted = catalog.QUERIES["claim_features"](spark, sf_dir)
    assert got.count() == wanted.count() and got.exceptAll(wanted).isEmpty()


def test_repeats_within_the_watermark_arrive_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0)), ("a", datetime(2024, 1, 1, 0)), ("b", datetime(2024, 1, 1, 1))], "id string, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.to_table(live.once_per_record(stream, "id", "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_sessions_equal_a_plain_scan(spark):
    times = [0, 10, 69, 70, 200, 259, 319, 320, 1000]
    df = spark.createDataFrame([("k", datetime.fromtimestamp(t)) for t in times], "key string, at timestamp")
    got = sorted((r.n, r.last_micros - r.first_micros) for r in bursts.burst_sessions(df, "key", "at", 60).collect())
    runs, run = [], [times[0]]
    for t in times[1:]:
        if t - run[-1] >= 60:
            runs.append(run)
            run = []
        run.append(t)
    runs.append(run)
    assert got == sorted((len(r), (r[-1] - r[0]) * 1_000_000) for r in runs)


def test_streaming_windows_and_sessions_equal_batch(spark, tmp_path):
    times = [0, 10, 69, 70, 200, 259, 319, 320, 1000, 1030, 5000]
    rows = [("k", t) for t in times] + [("other", t) for t in times[::2]]
    df = spark.createDataFrame([(k, datetime.fromtimestamp(t)) for k, t in rows], "key string, at timestamp")
    source = str(tmp_path / "in")
    for low, high in ((0, 100), (100, 500), (500, 6000)):
        df.where((F.col("at").cast("long") >= low) & (F.col("at").cast("long") < high)).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(None, datetime.fromtimestamp(1_000_000))], df.schema).write.mode("append").parquet(source)

    def drained(name, build):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        rows = build(stream)
        live.to_table(rows, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
        return {tuple(r) for r in spark.read.schema(rows.schema).parquet(str(tmp_path / name)).where("key IS NOT NULL").collect()}

    columns = ["key", "first_micros", "last_micros", "n"]
    batch = {tuple(r) for r in bursts.burst_sessions(df, "key", "at", 60).select(columns).collect()}
    assert drained("sessions", lambda s: bursts.burst_sessions(s, "key", "at", 60, "1 minute").select(columns)) == batch
    windows = {tuple(r) for r in bursts.burst_windows(df, "key", "at", "1 minute", "20 seconds").collect()}
    assert drained("windows", lambda s: bursts.burst_windows(s, "key", "at", "1 minute", "20 seconds", "1 minute")) == windows


@pytest.mark.parametrize("period", ["day", "month"])
def test_late_rows_have_their_own_table(spark, tmp_path, period):
    """Late rows, repeats within a batch and across batches, rows without a time, and a replayed batch."""
    def batch(*rows):
        return spark.createDataFrame([(i, None if d is None else datetime(2024, 1, d)) for i, d in rows], "id string, at timestamp")

    path = str(tmp_path / "split")
    deliveries = [batch(("a", 1), ("a", 1), ("b", 10)), batch(("b", 10), ("c", 12), ("old", 2), ("edge", 5)), batch(("d", 20), ("c", 12), ("none", None), ("b", 10)), batch()]
    for batch_id in (0, 1, 2, 1, 2, 3):
        late.split_batch(deliveries[batch_id], batch_id, "id", "at", timedelta(days=5), path, period)
    got = sorted((r.late, r.id) for r in late.read_split(spark, path, "id string, at timestamp").collect())
    # After the third batch the mark is the 7th: b and c are repeats within its reach.
    assert got == [(False, i) for i in ("a", "b", "c", "d", "edge")] + [(True, i) for i in ("none", "old")]
