"""Null handling shared by the feature builders."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def real(column: Column) -> Column:
    """NaN and null are one thing here: both become null."""
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def truthy(column: Column, zero) -> Column:
    """Null when the value is missing or the type's zero."""
    return F.nullif(column, F.lit(zero))


def optional(df: DataFrame, name: str, dtype: str) -> Column:
    """A column of ``df`` cast to ``dtype``, or a typed null when ``df`` has no such column."""
    if name not in df.columns:
        return F.lit(None).cast(dtype)
    column = F.col(name)
    fractional = dict(df.dtypes)[name] in ("float", "double")
    return (real(column) if fractional or dtype == "double" else column).cast(dtype)


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), column))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of ``df`` to null, inside structs and arrays too."""

    def clean(column: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return F.nanvl(column, F.lit(None).cast(dtype))
        if isinstance(dtype, T.StructType):
            fields = F.struct(*[clean(column[f.name], f.dataType).alias(f.name) for f in dtype])
            return F.when(column.isNotNull(), fields)
        if isinstance(dtype, T.ArrayType):
            return F.transform(column, lambda item: clean(item, dtype.elementType))
        return column

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows that have both values; null when either is constant there.

    The range tells a constant: merged partial deviations of one can come out a hair above zero.
    """
    both = x.isNotNull() & y.isNotNull()
    left, right = F.when(both, x), F.when(both, y)
    varies = (F.min(left) < F.max(left)) & (F.min(right) < F.max(right))
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    return F.when(varies, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))
