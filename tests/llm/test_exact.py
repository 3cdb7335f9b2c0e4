import hashlib

import pytest
from pyspark.sql import functions as F

from riskspark.llm import exact


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("salts", [1, 64])
def test_odd_rows(odd, odd_texts, salts):
    assert collected(exact.exact_duplicates(odd, salts=salts)) == brute(odd_texts)


def test_equal_digests_fall_back_to_whole_texts(odd, odd_texts):
    assert collected(exact.exact_duplicates(odd, digest=lambda text: F.substring(exact.sha256(text), 1, 0))) == brute(odd_texts)


def test_no_rows(nothing):
    assert exact.exact_duplicates(nothing).count() == 0


def test_hot_group(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact.exact_duplicates(docs.repartition(16))
    assert found.where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first() == (6667, 19998, 19998, 1)


def test_plan_has_no_python(odd):
    plan = exact.exact_duplicates(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
