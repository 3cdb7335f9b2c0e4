import random

import pytest

import corpus_pipeline
from riskspark.llm import simhash, similar
from riskspark.session import materialise
from tests.llm.test_components import brute as components


def plain_shingles(text):
    words = text.lower().split()
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {" ".join(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def expected(texts):
    """Component of each id of {id: text} by brute force over all pairs."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    joined = components([(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if jaccard(sets[a], sets[b]) >= 0.8])
    return {i: joined.get(i, i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    """Copies with some words changed, around and across 0.8; one large cluster; passages that many texts share."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    base = [rng.choices(vocabulary, k=rng.randint(80, 200)) for _ in range(40)]
    out = {i: " ".join(b) for i, b in enumerate(base)}
    for i in range(40, 400):
        words = list(base[0] if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out[i] = " ".join(words + passage if i % 7 == 0 else words)
    out |= {400: "only three words", 401: "Only  three\nWORDS", 402: "one two three four five", 403: "one two three four six"}
    return out


@pytest.mark.parametrize("block", [5, similar.BLOCK])
def test_components_against_brute_force_jaccard(spark, texts, block):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in similar.near_texts(docs, block=block).collect()}
    assert found == expected(texts)
    assert 40 < len(set(found.values())) < len(texts)


def test_the_stage_keeps_one_text_of_each_component(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    kept = materialise(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, ""), "test")
    assert {r.doc_id for r in kept.collect()} == {i for i, c in expected(texts).items() if i == c}


def test_odd_rows(odd, odd_texts, nothing):
    found = similar.near_texts(odd).collect()
    assert len(found) == len(odd_texts)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3, 10)} == {1}
    assert {r.component_id for r in found if r.doc_id in (4, 5)} == {4}
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert similar.near_texts(nothing).count() == 0


def test_fingerprints_of_five_words_link_by_pigeonring(spark, texts, monkeypatch):
    """The ring's links connect what fingerprints at three bits or fewer do, and all of them are compared."""
    rings, compared = [], []
    links, check = simhash.links, similar._compared
    monkeypatch.setattr(simhash, "links", lambda classes, block: rings.append(materialise(links(classes, block), "test")) or rings[-1])
    monkeypatch.setattr(similar, "_compared", lambda pairs, *rest: compared.append(materialise(pairs, "test")) or check(compared[-1], *rest))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar.near_texts(docs).collect()} == expected(texts)
    prints = {}
    for text in texts.values():
        own = similar.sketch(text.encode())[0]
        own -= (own >> 63) << 64
        prints.setdefault(simhash.fingerprint(text.encode(), similar.WIDTH), []).append(own)
    least = {p: min(own) for p, own in prints.items()}
    near = [(least[a], least[b]) for a in least for b in least if a < b and (a ^ b).bit_count() <= simhash.DISTANCE]
    found = [(r.a, r.b) for r in rings[0].collect()]
    assert near and components(found) == components(near)
    assert {frozenset(p) for p in found} <= {frozenset((r.a, r.b)) for r in compared[0].collect()}
