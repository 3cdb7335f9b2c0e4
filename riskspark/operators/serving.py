"""Latest-per-key state with expiry, as pure DataFrame steps."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_expiry(rows: DataFrame, ttl_seconds: int | None) -> DataFrame:
    """``expires_at`` from ``updated_at``; without a lifetime a row never expires."""
    if ttl_seconds is None:
        return rows.withColumn("expires_at", F.lit(None).cast(rows.schema["updated_at"].dataType))
    return rows.withColumn("expires_at", F.col("updated_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)))


def latest_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last write of each key. A ``max_by`` combines map-side, so a hot key is no hot task."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("last")
    return rows.groupBy(key).agg(last).select(key, "last.*")


def unexpired(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def without_keys(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def to_online_rows(snapshots: DataFrame, ttl_seconds: int | None = 3600) -> DataFrame:
    """Snapshot rows as ``(key, features, updated_at, expires_at)`` with JSON features."""
    rows = snapshots.select(
        F.col("record_id").alias("key"),
        F.to_json("features", {"ignoreNullFields": "false"}).alias("features"),
        F.col("timestamp").alias("updated_at"),
    )
    return with_expiry(rows, ttl_seconds)
