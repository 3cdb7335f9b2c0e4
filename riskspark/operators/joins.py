"""Lookup joins that stay balanced when a few keys hold much of the left side."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.session import materialise

#: No key of fewer left rows is ever split: any task can hold it.
LEAST_HOT_ROWS = 10_000


def hot_only(counts: DataFrame, weight: str, partitions: int) -> DataFrame:
    """The rows of ``counts`` for hot keys: those with more left rows than one partition's share of all.

    So at most ``partitions`` keys are hot, and any other key adds less than one share to its task.
    """
    total = counts.agg(F.sum(weight)).first()[0] or 0
    return counts.where(F.col(weight) > max(LEAST_HOT_ROWS, total / partitions))


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, how: str = "left", partitions: int | None = None) -> DataFrame:
    """Join ``left`` to ``right``, which is unique on ``key`` and knows each key's left row count.

    Use it where the right side comes from an aggregation: adaptive skew-join splitting needs a
    bare exchange on both sides and does not reach those plans. Rows of hot keys take their match
    from a broadcast table of bounded size and are then spread by ``spread`` over all partitions;
    the rest take the shuffle join. ``weight`` is a column of ``right``, which is written once.
    ``partitions`` is what the shuffle deals to, by default the session's setting.
    """
    right = materialise(right, "lookup")
    partitions = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    extra = [c for c in right.columns if c != key]
    payload = F.struct(*extra)
    hot = F.broadcast(hot_only(right, weight, partitions).select(F.col(key).alias("_hot_key"), payload.alias("_hot")))
    # The weight is at least 1, so every cold row sits on route 0. A hot row's route only chooses
    # the partition it travels to: its match is already there.
    cold = right.select(
        F.col(key).alias("_cold_key"), payload.alias("_cold"), F.least(F.col(weight), F.lit(0)).cast("bigint").alias("_at")
    )
    routed = left.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_route", F.when(F.col("_hot_key").isNotNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("bigint"))
    )
    joined = routed.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_route") == F.col("_at")), "left")
    matched = joined.withColumn("_match", F.coalesce("_hot", "_cold"))
    if how == "inner":
        matched = matched.where(F.col("_match").isNotNull())
    return matched.select(*left.columns, *[F.col("_match")[c].alias(c) for c in extra])
