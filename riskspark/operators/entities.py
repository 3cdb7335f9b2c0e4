"""Entity resolution: vehicles, persons, addresses, phones and policies.

Ids come from the key's hash, so the link from a source row to its entity is a projection and
needs no join. Where rows of one entity can differ, the first by source id stands: a ``min`` over
a struct, which combines map-side, so an entity behind a third of all rows is no hot spot.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import text, vin
from riskspark.functions.values import optional


def vehicles(quotes: DataFrame, *also: str) -> DataFrame:
    """One vehicle per quote, decoded from its surrogate VIN. ``also`` names quote columns to carry along."""
    code = vin.surrogate_vin(F.col("quote_id"), F.col("vehicle_power"), F.col("vehicle_msrp"))
    number = F.col("vin")
    return quotes.withColumn("vin", code).select(
        "vin",
        "quote_id",
        text.surrogate_id("v_", F.col("quote_id")).alias("vehicle_id"),
        vin.vin_year(number).alias("year"),
        vin.vin_make(number).alias("make"),
        vin.vin_model(number).alias("model"),
        F.lit("sedan").alias("body_type"),
        F.col("vehicle_msrp").cast("double").alias("msrp"),
        F.col("vehicle_power").cast("double").alias("horsepower"),
        F.col("vehicle_adas_score").cast("double").alias("adas_score"),
        F.col("vehicle_age_years").cast("int").alias("vehicle_age_years"),
        *also,
    )


def person_links(policyholders: DataFrame, claimants: DataFrame) -> DataFrame:
    """Source row to person, for both roles. Inputs carry ``source_id, name_raw, dob, state``."""

    def side(rows: DataFrame, role: str, rank: int) -> DataFrame:
        name = text.normalise_name(F.col("name_raw"))
        return rows.select(
            "source_id", name.alias("name_normalized"), "dob", "state",
            F.lit(role).alias("role"), F.lit(rank).alias("role_rank"),
        )

    both = side(policyholders, "policyholder", 0).unionByName(side(claimants, "claimant", 1))
    key = text.person_key(F.col("name_normalized"), F.col("dob"), F.col("state"))
    return both.withColumn("person_id", F.concat(F.lit("p_"), F.substring(key, 1, 32)))


def persons(links: DataFrame) -> DataFrame:
    """One row per person. A policyholder stays one when the same person also files claims."""
    first = F.min(F.struct("role_rank", "source_id", "name_normalized", "dob", "state", "role")).alias("first")
    return links.groupBy("person_id").agg(first).select(
        "person_id", "first.name_normalized", "first.dob", "first.state", "first.role"
    )


def address_links(contacts: DataFrame) -> DataFrame:
    """Source row to address. Input carries ``source_id, address_line1_raw, city_raw, state, zip_raw``."""
    full = text.normalise_address(F.col("address_line1_raw"), F.col("city_raw"), F.col("state"), F.col("zip_raw"))
    return contacts.select("source_id", full.alias("address_normalized"), "city_raw", "state", "zip_raw").withColumn(
        "address_id", text.surrogate_id("a_", F.lower("address_normalized"))
    )


def addresses(links: DataFrame) -> DataFrame:
    first = F.min(F.struct("source_id", "address_normalized", "city_raw", "state", "zip_raw")).alias("first")
    normalised = F.col("first.address_normalized")
    return links.groupBy("address_id").agg(first).select(
        "address_id",
        normalised.alias("address_normalized"),
        F.col("first.city_raw").alias("city"),
        "first.state",
        F.col("first.zip_raw").alias("zip"),
        text.short_hash(normalised).alias("address_hash"),
    )


def phone_links(contacts: DataFrame) -> DataFrame:
    """Source row to phone. Invalid numbers are entities too, but carry no number or hash."""
    digits = text.normalise_phone(F.col("phone_raw"))
    return contacts.select("source_id", digits.alias("phone_digits")).withColumns({
        "phone_id": text.surrogate_id("t_", F.col("phone_digits")),
        "is_valid": text.phone_is_valid(F.col("phone_digits")),
    })


def phones(links: DataFrame) -> DataFrame:
    """Every attribute is a function of the digits, so a plain distinct resolves phones."""
    valid = F.col("is_valid")
    return links.select("phone_id", "phone_digits", "is_valid").distinct().select(
        "phone_id",
        F.when(valid, F.col("phone_digits")).alias("phone_normalized"),
        F.when(valid, text.short_hash(F.col("phone_digits"))).alias("phone_hash"),
        "is_valid",
        F.lit("mobile").alias("phone_type"),
    )


def policies(quotes: DataFrame, as_of: Column) -> DataFrame:
    """One yearly policy per quote, started as long ago as the lapse says, at least one day."""
    lapse = F.coalesce(optional(quotes, "insurance_lapse_days", "int"), F.lit(0))
    dated = quotes.select(
        text.surrogate_id("pol_", F.col("quote_id")).alias("policy_id"),
        "quote_id",
        F.date_sub(as_of, F.greatest(F.lit(1), lapse)).alias("inception_date"),
    ).withColumn("expiration_date", F.date_add("inception_date", 365))
    expiry = F.col("expiration_date")
    return dated.withColumns({
        "status": F.when(expiry > as_of, "active").otherwise("lapsed"),
        "is_lapsed": expiry < as_of,
    })


def claims_before_inception(claims: DataFrame, policy_rows: DataFrame, as_of: Column) -> DataFrame:
    """How many claims have a policy, and how many sit on one that has not started by ``as_of``."""
    joined = claims.select("quote_id").join(policy_rows.select("quote_id", "inception_date"), "quote_id")
    return joined.agg(
        F.count(F.lit(1)).alias("claims_with_policy"),
        F.count_if(F.col("inception_date") > as_of).alias("claims_before_inception"),
    )
