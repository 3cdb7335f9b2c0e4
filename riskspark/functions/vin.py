"""Surrogate VINs and their decoding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.constants import (
    DEFAULT_VIN_MAKE, DEFAULT_VIN_MODEL, DEFAULT_VIN_YEAR, VIN_MAKES, VIN_MODELS, VIN_YEARS,
)


def plain_number(value: Column) -> Column:
    """Decimal text of a double with at least one digit after the point, never an exponent for whole numbers."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, F.concat(value.cast("bigint").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


def surrogate_vin(quote_id: Column, power: Column, msrp: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", quote_id, plain_number(power), plain_number(msrp)), 256)
    return F.concat(
        F.lit("1"), F.substring(digest, 1, 2), F.lit("V"), F.substring(digest, 3, 2),
        F.lit("D2"), F.substring(digest, 5, 2), F.lit("000001"),
    )


def _decode(vin: Column, position: int, table: dict, default) -> Column:
    lookup = F.expr(f"map({', '.join(f'{key!r}, {value!r}' for key, value in table.items())})")
    return F.coalesce(lookup[F.upper(F.substring(vin, position, 1))], F.lit(default))


def vin_year(vin: Column) -> Column:
    return _decode(vin, 10, VIN_YEARS, DEFAULT_VIN_YEAR)


def vin_make(vin: Column) -> Column:
    return _decode(vin, 2, VIN_MAKES, DEFAULT_VIN_MAKE)


def vin_model(vin: Column, position: int = 5) -> Column:
    """The model code is the fifth character; position 4 holds a constant and always gives the default."""
    return _decode(vin, position, VIN_MODELS, DEFAULT_VIN_MODEL)
