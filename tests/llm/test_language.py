import numpy as np
import public_tokenizers
import pytest

from riskspark.llm import language
from riskspark.llm.common import remainder, table

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, known):
    if not word:
        yield []
    for size in range(1, len(word) + 1):
        piece = known.get(word[:size], 0 if size == 1 else None)
        if piece is not None:
            for rest in segmentations(word[size:], known):
                yield [piece, *rest]


@pytest.fixture(scope="module")
def toy():
    known = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "ba": 6, "aba": 7}
    return known, language._table(np.random.default_rng(0).random((9, 3)))


def test_forward_sums_all_segmentations(toy):
    known, probabilities = toy
    words = ["▁abab", "▁a", "▁bxa", "▁ababa", "▁"]
    found = language.forward(words, known, probabilities)
    for w, got in zip(words, found):
        want = sum(np.prod([probabilities[p] for p in way], axis=0) for way in segmentations(w, known))
        assert np.allclose(got, np.log(want))


def test_expected_counts(toy):
    known, probabilities = toy
    words, weights = ["▁abab", "▁ba"], np.array([[2.0, 0, 1], [1, 3, 0]])
    want = np.zeros_like(probabilities)
    for w, weight in zip(words, weights):
        ways = list(segmentations(w, known))
        each = [np.prod([probabilities[p] for p in way], axis=0) for way in ways]
        for way, chance in zip(ways, each):
            for piece in way:
                want[piece] += weight * chance / sum(each)
    assert np.allclose(language.expected(words, weights, known, probabilities), want)


def test_long_runs_equal_short_ones(toy, monkeypatch):
    """With logarithms from the first letter on, sums and counts are the same; runs of any length are one run."""
    known, probabilities = toy
    words, weights = ["▁ababxab", "▁ba", "▁" + "ab" * 20], np.array([[2.0, 0, 1], [1, 3, 0], [1, 1, 5]])
    sums, counts = language.forward(words, known, probabilities), language.expected(words, weights, known, probabilities)
    monkeypatch.setattr(language, "PLAIN_LENGTH", 1)
    assert np.allclose(language.forward(words, known, probabilities), sums)
    assert np.allclose(language.expected(words, weights, known, probabilities), counts)
    long = "▁" + "abba" * 1000
    assert language.words("abba" * 1000) == [long] and np.isfinite(language.forward([long], known, probabilities)).all()


def test_whole_vocabulary_and_letters_only():
    known = language.pieces(PATH)
    assert language.longest(known) > 12
    assert [language.words(t) for t in ("²", "½ 3", "Ⅷ", "x² + ½y", "a_b1c")] == [[], [], [], ["▁x", "▁y"], ["▁a", "▁b", "▁c"]]


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    held = remainder("doc_id", 5) == 0
    model = language.train(docs.where(~held), PATH)
    assert model.languages == ["de", "en", "es", "fr"] and np.allclose(model.table.sum(axis=0), 1)
    found = language.identify(docs.where(held), model).join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_odd_rows(odd, odd_texts):
    model = language.train(odd, PATH, rounds=1)
    assert model.languages == ["en"]
    found = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    for i, t in odd_texts:
        assert (i, *(("en", 1.0) if any(c.isalpha() for c in t or "") else ("und", 0.0))) in found
    assert language.identify(odd, model).count() == len(odd_texts)


def test_small_cache_and_no_rows(odd, nothing, monkeypatch):
    scorer = language.Scorer(language.train(odd, PATH, rounds=1))
    monkeypatch.setattr(language, "CACHED_WORDS", 1)
    assert [x[0] for x in scorer.score(["some words", "other words", None, ""])] == ["en", "en", "und", "und"]
    empty = language.train(nothing, PATH)
    assert empty.languages == []
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(nothing, empty).count() == 0
