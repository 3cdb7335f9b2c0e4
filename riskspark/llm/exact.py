"""Exact deduplication by skew-safe combining, with DataFrame operations only.

1. Locally: copies within a partition collapse in the map-side half of a grouped aggregate whose key
   holds the digest *and* the whole text.
2. Salted: what is left of a digest is spread over salts (from the partition number) and merged there.
3. Globally: the salt winners, at most one for each salt and text, are merged.

Only texts whose cheap 64-bit hash occurs more than once take part, as any other text has no copy.
No group is ever gathered: each stage keeps the largest id and a count. Rows then find their winner by
digest, or by digest and whole text where two texts share a digest.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import sized, whole
from riskspark.session import materialise

SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def repeated_texts(rows: DataFrame, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """``_digest``, ``_text``, ``keep_id``, ``group_size`` of every text that may occur more than once."""
    quick = F.xxhash64("_text").alias("_quick")
    often = materialise(rows.groupBy(quick).count().where("count > 1").select("_quick"), "repeated")
    candidates = rows.withColumn("_quick", quick).join(sized(often, often.count()), "_quick", "left_semi")
    salted = (
        candidates.withColumn("_digest", digest(F.col("_text")))
        .withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_id"), F.count("*").alias("_n"))
    )
    return salted.groupBy("_digest", "_text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    digest: Callable[[Column], Column] = sha256, salts: int = SALTS,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if they are identical; a null text counts as empty. The largest id stays. Rows that
    repeat both id and text count in ``group_size`` and share the id's decision; null ids lose against any
    other id, and a group of null ids only keeps them. Other columns are ignored. No rows give no rows.
    """
    rows = docs.select(F.col(id_column).alias("_id"), whole(text_column).alias("_text"))
    winners = materialise(repeated_texts(rows, digest, salts), "winners")
    clashing = winners.groupBy("_digest").count().where("count > 1").select("_digest")
    keyed = rows.withColumn("_digest", digest(F.col("_text"))).withColumn("text_sha256", sha256(F.col("_text")))
    if clashing.isEmpty():
        # Full comparison found one text for each digest, so the digest stands for the text.
        found = keyed.drop("_text").join(winners.drop("_text"), "_digest", "left")
    else:
        found = keyed.join(winners, ["_digest", "_text"], "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("_id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("_id").alias(id_column), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


#: Twin of the query over ``documents``.
SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
 sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
