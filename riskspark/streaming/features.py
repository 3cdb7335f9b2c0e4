"""Streaming feature vectors and the sinks behind them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskspark.operators.features import claim_features, quote_features, snapshots
from riskspark.sources.feature_store import save


def once_per_record(stream: DataFrame, id_column: str, event_time: str, lateness: str) -> DataFrame:
    """Drop repeats of a record id. Rows later than ``lateness`` behind the newest are lost, so it must cover the source."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([id_column])


def quote_feature_stream(quotes: DataFrame) -> DataFrame:
    """Stateless: the very projection of the batch side."""
    return quote_features(quotes)


def claim_feature_stream(claims: DataFrame, underwriting: DataFrame) -> DataFrame:
    """Claims as they arrive, each with its quote from the static underwriting table."""
    return claim_features(claims, underwriting)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows to a Parquet table until the source is drained."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def serve(
    stream: DataFrame, record_type: str, offline_path: str, online_path: str, checkpoint: str, as_of: Column,
    underwriting: DataFrame | None = None, ttl_seconds: int | None = 3600,
) -> StreamingQuery:
    """Each micro-batch goes through the batch builders, then to both stores under its batch id.

    The batch id makes a replay harmless, and inside the batch the joins are planned adaptively.
    """

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        vectors = quote_features(rows) if record_type == "quote" else claim_features(rows, underwriting)
        save(snapshots(vectors, record_type, as_of), offline_path, online_path, batch_id, record_type, ttl_seconds)

    writer = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
