import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from riskspark.functions import text, vin
from riskspark.operators import entities


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("name", ["o'brien-smith", "  MARY ann ", "nation_3", "1st avenue", "élan vital", ""])
def test_title_case_like_python(spark, name):
    assert one(spark, name, text.normalise_name) == name.strip().title()


@pytest.mark.parametrize("raw,out,valid", [
    ("(212) 555-0123", "2125550123", True), ("1-212-555-0123", "2125550123", True), ("212.555.0123", "2125550123", True),
    ("5550123", "5550123", False), (None, "", False), ("2-212-555-0123", "22125550123", False),
])
def test_phone(spark, raw, out, valid):
    assert one(spark, raw, text.normalise_phone) == out
    assert one(spark, out, text.phone_is_valid) is valid


def test_address_spellings_meet(spark):
    rows = [("100 Main St", "los angeles"), ("100 Main St.", "LOS ANGELES"), (" 100 Main Street ", "Los Angeles")]
    df = spark.createDataFrame(rows, "line string, city string")
    out = {r[0] for r in df.select(text.normalise_address(F.col("line"), F.col("city"), F.lit("ca"), F.lit("90001"))).collect()}
    assert out == {"100 Main Street, Los Angeles, CA 90001"}
    assert one(spark, "5 Oak Ave", text.address_line) == "5 Oak Avenue"
    assert one(spark, "5 Stone Dr. Apt 2", text.address_line) == "5 Stone Drive Apt 2"


def test_keys(spark):
    assert one(spark, " (555) 1-2.3 A", text.graph_key) == "555123a"
    key = hashlib.sha256(b"phone:2125550123").hexdigest()[:16]
    assert one(spark, "(212) 555-0123", lambda c: text.entity_id("phone", c)) == f"e_{key}"
    assert int(one(spark, "abc", text.hash_prefix_number)) == int(hashlib.sha256(b"abc").hexdigest()[:16], 16)
    person = hashlib.sha256(b"maryann:1990-01-02:TX").hexdigest()
    assert one(spark, "Mary Ann", lambda c: text.person_key(c, F.lit("1990-01-02"), F.lit("TX"))) == person


@pytest.mark.parametrize("power,msrp", [(200.0, 45000.0), (213.25, 12345678.0), (80.5, 30000.125)])
def test_vin_matches_the_hash_of_plain_numbers(spark, power, msrp):
    digest = hashlib.sha256(f"Q-1:{power}:{msrp}".encode()).hexdigest()
    code = spark.range(1).select(vin.surrogate_vin(F.lit("Q-1"), F.lit(power), F.lit(msrp))).first()[0]
    assert code == f"1{digest[:2]}V{digest[2:4]}D2{digest[4:6]}000001"


def test_vin_decoding(spark):
    assert one(spark, "12aVb1D2f7000001", vin.vin_year) == 2019
    assert one(spark, "12aVb1D2f7000001", vin.vin_make) == "Ford"
    assert one(spark, "12aVb1D2f7000001", vin.vin_model) == "3 Series"
    assert one(spark, "12aVb1D2f7000001", lambda c: vin.vin_model(c, 4)) == "Civic"
    assert one(spark, "", vin.vin_year) == 2023 and one(spark, "1!", vin.vin_make) == "Toyota"


def test_persons_prefer_the_policyholder_and_the_first_source(spark):
    schema = "source_id string, name_raw string, dob string, state string"
    holders = spark.createDataFrame([("Q2", "ANN LEE", "1990-01-01", "TX"), ("Q1", " ann  lee", "1990-01-01", "TX")], schema)
    filers = spark.createDataFrame([("A0", "Ann Lee", "1990-01-01", "TX"), ("C1", "Bob Ray", "1980-01-01", "NV")], schema)
    links = entities.person_links(holders, filers)
    rows = {r.name_normalized: r for r in entities.persons(links).collect()}
    assert len(rows) == 2 and rows["Ann  Lee"].role == "policyholder" and rows["Bob Ray"].role == "claimant"
    assert links.select("person_id").distinct().count() == 2
    again = entities.persons(links.unionByName(links))
    assert again.exceptAll(entities.persons(links)).isEmpty()


def test_phones_collapse_and_invalid_ones_lose_their_number(spark):
    raw = spark.createDataFrame([("a", "(212) 555-0123"), ("b", "12125550123"), ("c", "5550123")], "source_id string, phone_raw string")
    rows = entities.phones(entities.phone_links(raw)).collect()
    assert sorted((r.is_valid, r.phone_normalized, r.phone_hash is None) for r in rows) == [
        (False, None, True), (True, "2125550123", False)
    ]


def test_policies_follow_the_given_day(spark):
    quotes = spark.createDataFrame([("a", 0), ("b", None), ("c", 400), ("d", 365)], "quote_id string, insurance_lapse_days int")
    rows = {r.quote_id: r for r in entities.policies(quotes, F.lit(date(2024, 6, 30))).collect()}
    assert rows["a"].inception_date == rows["b"].inception_date == date(2024, 6, 29)
    assert (rows["a"].status, rows["a"].is_lapsed) == ("active", False)
    assert (rows["c"].status, rows["c"].is_lapsed) == ("lapsed", True)
    # Expiring today: no longer active, not yet past.
    assert (rows["d"].status, rows["d"].is_lapsed) == ("lapsed", False)
    assert rows["a"].policy_id == entities.policies(quotes, F.lit(date(2024, 6, 30))).where("quote_id = 'a'").first().policy_id
