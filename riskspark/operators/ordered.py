"""Running totals over an order, and exact quantiles, without ever sorting a whole column in one task.

Equal values are grouped first, so a value held by a third of all rows is one row. The groups are then
placed by a range shuffle in as many ranges as their number asks for. A window runs inside each range
only, and a second, small one over the ranges' totals gives each range its starting offset.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import materialise

#: Distinct values in a range, about: one task orders so many.
RANGE_ROWS = 1_000_000


def numeric(df: DataFrame, value: str) -> DataFrame:
    """Rows whose ``value``, as a double, is neither null nor not a number."""
    return df.withColumn(value, F.col(value).cast("double")).where(F.col(value).isNotNull() & ~F.isnan(value))


def running_totals(df: DataFrame, value: str, totals: dict, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per distinct ``value`` (of each ``by``) with each total and its sum over all smaller values.

    ``totals`` maps an output name to an aggregate of ``df``. Output ``<name>`` is the value's own
    total and ``<name>_before`` the sum before it within ``by``. Values are compared as doubles;
    nulls and not-a-numbers are left out.
    """
    names, keys = list(totals), [*by, value]
    grouped = numeric(df, value).groupBy(*keys).agg(*[aggregate.alias(name) for name, aggregate in totals.items()])
    ordered = materialise(grouped.withColumn("_range", F.lit(0)), "groups")
    ranges = -(-ordered.count() // range_rows)
    if ranges > 1:
        placed = ordered.drop("_range").repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id())
        ordered = materialise(placed, "ranges")
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(*before)
    own = {f"{name}_before": F.coalesce(F.sum(name).over(inside), F.lit(0)) for name in names}
    rows = ordered.withColumns(own)
    if ranges > 1:
        # One row for each range, and for each of the few groups of ``by`` that begin within one.
        across = Window.partitionBy(*by).orderBy("_range").rowsBetween(*before)
        per_range = ordered.groupBy(*by, "_range").agg(*[F.sum(name).alias(name) for name in names])
        offsets = per_range.select(*by, "_range", *[F.coalesce(F.sum(name).over(across), F.lit(0)).alias(f"_offset_{name}") for name in names])
        rows = rows.join(offsets, [*by, "_range"]).withColumns({f"{name}_before": F.col(f"{name}_before") + F.col(f"_offset_{name}") for name in names})
    return rows.select(*keys, *names, *own)


def grouped_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation, one row for each group of ``by``; ``quantiles`` maps names to fractions."""
    ranked = running_totals(df, value, {"n": F.count(F.lit(1))}, by, range_rows)
    ranked = materialise(ranked, "ranked") if by else ranked
    if by:
        sizes = ranked.groupBy(*by).agg(F.sum("n").alias("_size"))
        ranked, size = ranked.join(sizes, list(by)), F.col("_size")
    else:
        size = numeric(df, value).agg(F.count(F.lit(1))).scalar()
    first, last = F.col("n_before"), F.col("n_before") + F.col("n")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < last), F.col(value)))

    parts = []
    for name, fraction in quantiles.items():
        position = (size - 1).cast("double") * F.lit(fraction)
        parts += [
            at(F.floor(position)).alias(f"{name}_low"),
            at(F.ceil(position)).alias(f"{name}_high"),
            F.max(position - F.floor(position)).alias(f"{name}_part"),
        ]
    found = ranked.groupBy(*by).agg(*parts)
    return found.select(*by, *[
        (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")).alias(name)
        for name in quantiles
    ])


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, as one row. ``quantiles`` maps names to fractions."""
    return grouped_quantiles(df, value, quantiles)


def approximate_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """One pass and a mergeable sketch, where an exact answer is not worth two shuffles."""
    return df.agg(*[F.percentile_approx(value, q, accuracy).alias(name) for name, q in quantiles.items()])
