"""On-time and late records of a stream, each in a table of its own.

A streaming watermark drops late rows without a trace, unless it is set so wide that every key stays in state. Here
a batch splits itself: rows older than the watermark that earlier batches left behind go to the late table, the rest, once
per id, to the on-time table. What is kept to tell repeats is the on-time table itself, partitioned by day (or another period), of which a batch
reads only the days the watermark still reaches. Every write is a folder of the batch's own, so a replay changes nothing.
"""

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskspark.session import materialise


def _before(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """Rows of earlier batches; none before the first write."""
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("batch_id") < batch_id)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def split_batch(rows: DataFrame, batch_id: int, id_column: str, event_time: str, lateness: timedelta, path: str, period: str = "day") -> None:
    """Put one batch into ``path/on_time`` and ``path/late``; its newest moment goes to ``path/marks``.

    The watermark is the newest moment of earlier batches less ``lateness``; a row before it is late. Rows without a
    time are late, as no watermark can place them. Repeats of an id within the watermark's reach are dropped. ``period``
    (day, week, month) is what both tables are partitioned by: a coarser one means fewer folders where batches span years.
    """
    spark = rows.sparkSession
    own = materialise(rows, "batch")
    kind = dict(own.dtypes)
    newest = _before(spark, f"{path}/marks", batch_id, f"newest {kind[event_time]}, batch_id bigint").agg(F.max("newest")).first()[0]
    mark = None if newest is None else newest - lateness
    late = F.col(event_time).isNull() if mark is None else F.coalesce(F.col(event_time) < F.lit(mark).cast(kind[event_time]), F.lit(True))
    day = F.to_date(F.date_trunc(period, event_time))
    once = own.where(~late).groupBy(id_column).agg(F.min_by(F.struct(*[c for c in own.columns if c != id_column]), event_time).alias("row"))
    arrived = once.select(id_column, "row.*").select(own.columns)
    if mark is not None:
        known = _before(spark, f"{path}/on_time", batch_id, f"`{id_column}` {kind[id_column]}, `{event_time}` {kind[event_time]}, batch_id bigint, day date")
        reach = known.where((F.col("day") >= F.to_date(F.date_trunc(period, F.lit(mark).cast("timestamp")))) & (F.col(event_time) >= F.lit(mark).cast(kind[event_time])))
        arrived = arrived.join(reach.select(id_column), id_column, "left_anti").select(own.columns)
    for name, part in (("on_time", arrived), ("late", own.where(late))):
        # A day's rows meet in a few tasks, a hot day's in as many as it needs, so a batch writes few files.
        part.withColumn("day", day).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/{name}/batch_id={batch_id}")
    own.agg(F.max(event_time).alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")


def split_late(stream: DataFrame, id_column: str, event_time: str, lateness: timedelta, path: str, checkpoint: str, period: str = "day") -> StreamingQuery:
    """Run ``split_batch`` on every micro-batch until the source is drained."""

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        split_batch(rows, batch_id, id_column, event_time, lateness, path, period)

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_split(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Both tables with a column ``late``; ``schema`` is that of the stream's rows."""
    parts = [
        spark.read.schema(schema).parquet(f"{path}/{name}").withColumn("late", F.lit(flag)) for name, flag in (("on_time", False), ("late", True))]
    return parts[0].unionByName(parts[1])
