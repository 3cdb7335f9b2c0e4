"""Snapshot tables (offline) and the keyed serving table (online)."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import schemas
from riskspark.functions.values import nan_to_null
from riskspark.operators.serving import latest_per_key, to_online_rows, unexpired
from riskspark.sources.tables import MissingUpstreamTable

FEATURE_SCHEMAS = {"quote": schemas.QUOTE_FEATURES, "claim": schemas.CLAIM_FEATURES}
REQUIRED = {"quote": schemas.REQUIRED_QUOTE_FEATURES, "claim": schemas.REQUIRED_CLAIM_FEATURES}


def write_snapshots(snapshots: DataFrame, path: str, record_type: str, batch_id: int = 0, fmt: str = "parquet") -> str:
    """Add one batch of snapshots of one type; returns the batch's folder.

    A batch owns its folder and overwrites it, so a replay changes nothing and older batches stay.
    Not-a-numbers are stored as nulls.
    """
    writer = nan_to_null(snapshots.drop("record_type")).write.format(fmt).mode("overwrite")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    folder = f"{path}/record_type={record_type}/batch_id={batch_id}"
    writer.save(folder)
    return folder


def read_snapshots(spark: SparkSession, path: str, record_type: str, batch_id: int | None = None) -> DataFrame:
    """All snapshots of a type, or those of one batch: then only its folder is read."""
    schema = schemas.snapshot(FEATURE_SCHEMAS[record_type])
    stored = T.StructType([f for f in schema if f.name != "record_type"])
    batch = "" if batch_id is None else f"/batch_id={batch_id}"
    rows = spark.read.schema(stored).parquet(f"{path}/record_type={record_type}{batch}")
    return rows.withColumn("record_type", F.lit(record_type)).select(schema.names)


def read_snapshot(spark: SparkSession, path: str, record_id: str, record_type: str, version: str | None = None) -> DataFrame:
    """Point read: zero rows when absent. Only the type's folder is listed, and the id filter is pushed down."""
    rows = read_snapshots(spark, path, record_type).where(F.col("record_id") == record_id)
    return rows.where(F.col("feature_store_version") == version) if version else rows


def read_snapshots_json(spark: SparkSession, path: str, record_type: str) -> DataFrame:
    """Tolerant bulk read of JSON lines.

    A line that is no JSON keeps its text in ``_corrupt``; missing keys are listed, since a parsed
    null cannot be told from an absent key.
    """
    folder = f"{path}/record_type={record_type}"
    try:
        lines = spark.read.text(folder).select("value")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingUpstreamTable(f"{folder} not found: nothing was delivered there") from error
    schema = schemas.snapshot(FEATURE_SCHEMAS[record_type])
    parsed = F.from_json("value", T.StructType([*schema, T.StructField("_corrupt", T.StringType())]), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
    })

    def missing(keys: list[str], text: Column) -> Column:
        return F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce(F.json_object_keys(text), F.array()))

    # The type is the folder's name, so it is no key of the stored document.
    envelope = [k for k in schemas.ENVELOPE_KEYS if k != "record_type"]
    rows = lines.select(
        parsed.alias("row"),
        missing(envelope, F.col("value")).alias("missing_envelope"),
        missing(REQUIRED[record_type], F.get_json_object("value", "$.features")).alias("missing_features"),
    )
    return rows.select("row.*", "missing_envelope", "missing_features").withColumn("record_type", F.lit(record_type))


ONLINE = "key string, features string, updated_at timestamp, expires_at timestamp, deleted boolean"
# Folders per batch of the serving table: a point read opens one of them.
BUCKETS = 64


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.hash("key"), F.lit(BUCKETS)))


def upsert(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch of ``(key, features, updated_at, expires_at)``.

    A batch owns its folder and overwrites it, so a replay changes nothing. Nothing else is
    rewritten: the latest row per key is chosen when read.
    """
    marked = rows if "deleted" in rows.columns else rows.withColumn("deleted", F.lit(False))
    target = f"{path}/batch_id={batch_id}"
    # One row per key before the buckets are formed: a key with many updates stays one row.
    # Each bucket is written by several tasks: as many as make use of all shuffle partitions.
    salts = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    salt = F.pmod(F.xxhash64("key"), F.lit(salts))
    ordered = _bucketed(latest_per_key(marked, "key", "updated_at", "features")).repartition("bucket", salt).sortWithinPartitions("bucket", "key")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(target)


def delete(keys: DataFrame, path: str, batch_id: int, as_of: Column) -> None:
    """Deletion is a write too: later writes of the key bring it back."""
    tombstones = keys.select(
        "key", F.lit(None).cast("string").alias("features"), as_of.cast("timestamp").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("expires_at"), F.lit(True).alias("deleted"),
    )
    upsert(tombstones, path, batch_id)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ONLINE}, batch_id bigint, bucket int").parquet(path)


def _live(rows: DataFrame, as_of: Column) -> DataFrame:
    latest = latest_per_key(rows.drop("bucket"), "key", "updated_at", "batch_id")
    return unexpired(latest.where(~F.col("deleted")), as_of).select("key", "features", "updated_at", "expires_at")


def online_view(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Every live key with its latest features."""
    return _live(_stored(spark, path), as_of)


def get(spark: SparkSession, path: str, key: str, as_of: Column) -> DataFrame:
    """One key's live row, or none. The bucket, a constant once planned, prunes folders before the key is searched."""
    bucket = F.pmod(F.hash(F.lit(key)), F.lit(BUCKETS))
    return _live(_stored(spark, path).where((F.col("bucket") == bucket) & (F.col("key") == key)), as_of)


def compact(spark: SparkSession, path: str, target: str, as_of: Column) -> None:
    """Write the live rows as the first batch of a new table; swap paths once it is complete."""
    upsert(online_view(spark, path, as_of), target, 0)


def save(snapshots: DataFrame, offline_path: str, online_path: str, batch_id: int, record_type: str, ttl_seconds: int | None = 3600) -> DataFrame:
    """Persist snapshots offline and upsert their features online; returns the snapshots as stored.

    The input is evaluated once: the second sink reads what the first has written.
    """
    folder = write_snapshots(snapshots, offline_path, record_type, batch_id)
    kept = T.StructType([f for f in snapshots.schema if f.name != "record_type"])
    stored = snapshots.sparkSession.read.schema(kept).parquet(folder).withColumn("record_type", F.lit(record_type)).select(snapshots.columns)
    upsert(to_online_rows(stored, ttl_seconds), online_path, batch_id)
    return stored
