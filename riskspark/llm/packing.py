"""Packing into optimal length buckets.

The histogram of token counts up to the batch budget (so of a bounded size) comes to the driver, where
dynamic programming picks the bucket bounds that need the least padding. Rows are then numbered inside
their bucket without gathering it: a bucket is cut into hash cells of bounded size, rows are numbered in
each cell, and running totals over the few cells give the offsets. Every batch of a bucket holds as many
rows as fit the token budget when padded to the bucket's bound.
"""

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import sized, whole
from riskspark.session import materialise

#: Tokens in a padded batch, buckets at most, rows numbered together (about).
BUDGET, BUCKETS, CELL_ROWS = 8192, 24, 50_000


class Bucket(NamedTuple):
    bound: int
    rows: int


def word_count(text: Column) -> Column:
    """Tokens of a text: runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bounds (a subset of ``lengths``, the largest included) of at most ``buckets`` buckets with the least padding.

    ``lengths`` are distinct and ascending. ``best[j]`` is the least padding of the first j lengths; the best cut
    moves only forward with j, so each search starts at the one before. Among equals the earliest cut is taken.
    """
    n = len(lengths)
    if not n:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut, at = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), 0
        new[0] = 0
        for j in range(1, n + 1):
            costs = best[at:j] + lengths[j - 1] * (rows[j] - rows[at:j]) - (tokens[j] - tokens[at:j])
            at += int(costs.argmin())
            new[j], cut[j] = costs.min(), at
        best = new
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def choose_buckets(lengths: DataFrame, budget: int, buckets: int) -> list[Bucket]:
    """Buckets from the histogram of column ``n_tokens``: at most ``budget + 1`` rows are collected."""
    found = lengths.where(F.col("n_tokens") <= budget).groupBy("n_tokens").count().orderBy("n_tokens").collect()
    sizes = np.array([r["n_tokens"] for r in found], np.int64)
    counts = np.array([r["count"] for r in found], np.int64)
    out, low = [], -1
    for bound in best_bounds(sizes, counts, buckets):
        out.append(Bucket(bound, int(counts[(sizes > low) & (sizes <= bound)].sum())))
        low = bound
    return out


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokens: Column | None = None,
    budget: int = BUDGET, buckets: int = BUCKETS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``bucket``, ``bound``, ``batch``, ``slot``.

    ``tokens`` is the token count (words of the text by default; negative and null counts are 0). A row with more
    tokens than the budget is a batch of its own, in the bucket after the last, unpadded. Rows of a bucket are in the
    order of their id's hash; repeated ids take neighbouring places in any order, but for ids of more than a quarter of
    ``cell_rows`` rows, which are dealt over all places. Texts of any length are counted whole. Null and empty texts have no token
    and are in the first bucket. Null ids are packed like any other. No rows give no rows.
    """
    count = word_count(whole(text_column)) if tokens is None else F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0))
    # An id of many rows would be one cell: its rows are told apart by a number written with them.
    rows = materialise(docs.select(F.col(id_column), count.alias("n_tokens"), F.monotonically_increasing_id().alias("_number")), "lengths")
    often = materialise(rows.groupBy(F.col(id_column).alias("_often")).count().where(F.col("count") > cell_rows // 4).select("_often"), "often")
    rows = rows.join(sized(often.withColumn("_salted", F.lit(True)), often.count()), F.col(id_column).eqNullSafe(F.col("_often")), "left").select(
        id_column, "n_tokens", F.when(F.col("_salted"), F.col("_number")).otherwise(0).alias("_salt"))
    chosen = choose_buckets(rows, budget, buckets)
    over = len(chosen)
    bucket, cells, bound = F.lit(over), F.lit(None).cast("long"), F.col("n_tokens")
    for i, b in reversed(list(enumerate(chosen))):
        inside = F.col("n_tokens") <= b.bound
        bucket = F.when(inside, i).otherwise(bucket)
        bound = F.when(inside, b.bound).otherwise(bound)
        cells = F.when(inside, -(-b.rows // cell_rows)).otherwise(cells)
    long_rows = rows.where(F.col("n_tokens") > budget).count()
    order = F.when(F.col("_salt") == 0, F.xxhash64(id_column)).otherwise(F.xxhash64(id_column, "_salt"))
    placed = rows.select(
        id_column, "n_tokens", bucket.alias("bucket"), bound.cast("long").alias("bound"), order.alias("_order"),
        F.pmod(order, F.coalesce(cells, F.lit(max(1, -(-long_rows // cell_rows))))).alias("_cell"))
    totals = materialise(placed.groupBy("bucket", "_cell").count(), "cells")
    offsets = totals.select("bucket", "_cell", (F.sum("count").over(Window.partitionBy("bucket").orderBy("_cell")) - F.col("count")).alias("_offset"))
    numbered = placed.withColumn("_row", F.row_number().over(Window.partitionBy("bucket", "_cell").orderBy("_order", id_column)) - 1)
    place = F.col("_row") + F.col("_offset")
    capacity = F.when(F.col("bound") > budget, 1).otherwise(F.floor(F.lit(budget) / F.greatest("bound", F.lit(1)))).cast("long")
    return numbered.join(sized(offsets, totals.count()), ["bucket", "_cell"]).select(
        id_column, "n_tokens", "bucket", "bound", F.floor(place / capacity).alias("batch"), (place % capacity).alias("slot"))
