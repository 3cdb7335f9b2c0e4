from pyspark.sql import functions as F

import corpus_pipeline
from riskspark.llm import pii
from riskspark.llm.common import table
from riskspark.session import materialise
from tests.llm.conftest import CLASHING
from tests.llm.test_similar import expected


def stage(spark, name, docs):
    return materialise(dict(corpus_pipeline.STAGES)[name](spark, docs, ""), "test")


def near_kept(texts):
    """Ids that stay of {id: text}: the smallest of each group by brute-force similarity of all pairs."""
    return {i for i, least in expected(texts).items() if i == least}


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = stage(spark, "language", docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    two = stage(spark, "exact_dedup", one)
    largest = {}
    for i in sorted(r.doc_id for r in one.collect()):
        largest[texts[i]] = i
    assert {r.doc_id for r in two.collect()} == set(largest.values())
    three = stage(spark, "near_dedup", two)
    assert {r.doc_id for r in three.collect()} == near_kept({i: t for t, i in largest.items()})
    four = stage(spark, "personal_data", three)
    spans = {r.doc_id: r.spans for r in pii.report(pii.detect(three)).collect()}
    assert four.columns == docs.columns and four.count() == three.count()
    for r in four.collect():
        clean, at = "", 0
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans[r.doc_id].split(",") if s)), key=lambda s: s[1:]):
            if a >= at:
                clean += texts[r.doc_id][at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        assert r.text == clean + texts[r.doc_id][at:] and r.n_chars == len(r.text)
    five = stage(spark, "packing", four).collect()
    assert {r.doc_id: r.n_tokens for r in five} == {r.doc_id: len(r.text.encode().split()) for r in four.collect()}
    assert [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).orderBy("doc_id").collect()] == sorted(tuple(r) for r in five)


def test_odd_rows(spark, odd, odd_texts):
    docs = odd
    counts = []
    for name, function in corpus_pipeline.STAGES:
        docs = materialise(function(spark, docs, ""), "test")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == odd.columns and docs.where(F.col(CLASHING[0]) != "clash").count() == 0
    letters = [(i, t) for i, t in odd_texts if any(c.isalpha() for c in t or "")]
    assert counts[0] == len(letters) and counts[1] == len(letters) - 1  # id 4 goes; both rows of id 5 stay
    assert counts[2] == counts[3] == counts[4] == counts[1]


def test_no_rows(spark, nothing):
    docs = nothing
    for _, function in corpus_pipeline.STAGES:
        docs = materialise(function(spark, docs, ""), "test")
        assert docs.count() == 0
