"""Normalisers and keys for names, addresses, phones and graph attributes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.constants import STREET_SUFFIXES

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))


def title_case(text: Column) -> Column:
    """Each run of letters gets a capital first letter; digits and marks start a new run."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    capital = F.transform(
        runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2))))
    )
    return F.array_join(capital, "")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def surrogate_id(prefix: str, key: Column) -> Column:
    """128 bits of the key's hash: stable between runs, safe from collisions at any table size."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 32))


def hash_prefix_number(key: Column) -> Column:
    """The first 64 bits of a SHA-256 as an unsigned number."""
    return F.conv(short_hash(key), 16, 10).cast("decimal(20,0)")


def address_line(line1: Column) -> Column:
    """Dotted suffixes are expanded anywhere, undotted ones only as the last word."""
    expanded = strip(line1)
    for short, long in STREET_SUFFIXES.items():
        expanded = F.replace(expanded, F.lit(f"{short}."), F.lit(long))
    for short, long in STREET_SUFFIXES.items():
        expanded = F.regexp_replace(expanded, rf"\b{short}$", long)
    return expanded


def normalise_address(line1: Column, city: Column, state: Column, zip_code: Column) -> Column:
    joined = F.concat(
        address_line(line1), F.lit(", "), title_case(strip(city)), F.lit(", "),
        F.upper(strip(state)), F.lit(" "), strip(zip_code),
    )
    return F.replace(joined, F.lit("  "), F.lit(" "))


def normalise_phone(phone: Column) -> Column:
    """Digits only, without the country code. The result may still be invalid."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", "")
    national = (F.length(digits) == 11) & digits.startswith("1")
    return F.when(national, F.substr(digits, F.lit(2))).otherwise(digits)


def phone_is_valid(normalised: Column) -> Column:
    return F.length(normalised) == 10


def normalise_name(name: Column) -> Column:
    return title_case(strip(name))


def person_key(name: Column, dob: Column, state: Column) -> Column:
    compact = F.replace(F.lower(name), F.lit(" "), F.lit(""))
    return F.sha2(F.concat(compact, F.lit(":"), dob, F.lit(":"), F.coalesce(state, F.lit(""))), 256)


def graph_key(value: Column) -> Column:
    return F.translate(F.lower(strip(value)), "()-. ", "")


def entity_id(attr_type: str, value: Column) -> Column:
    return F.concat(F.lit("e_"), short_hash(F.concat(F.lit(f"{attr_type}:"), graph_key(value))))
