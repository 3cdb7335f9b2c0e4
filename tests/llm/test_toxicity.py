import random

import numpy as np

from riskspark.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["on", "er", "th", "in", "an", "re", "nd", "ha", "st", "le", "ou", "ti"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgblat", "quxpest", "vilefizz"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_learns_planted_words(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.where("doc_id < 600").select("doc_id", "text"), docs.where("doc_id < 600").select("doc_id", "toxic"))
    truth = {i: y for i, _, y in rows}
    found = toxicity.score(docs.where("doc_id >= 600"), model).collect()
    assert all(0 <= r.score <= 1 for r in found)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in found]) > 0.95


def test_windows_cover_the_whole_text():
    for size in (0, 1, 63, 64, 65, 112, 113, 1000):
        data = bytes(i % 251 for i in range(size))
        for width, step in toxicity.WINDOWS:
            parts = toxicity.windows(data, width, step)
            assert all(len(p) <= width for p in parts)
            assert parts[0] + b"".join(p[width - step:] for p in parts[1:]) == data


def test_cover_is_greedy():
    assert toxicity.cover([[0, 1], [0], [1, 2], [2], [3]], 1) == [0, 2, 3]
    assert toxicity.cover([[0], [0], [1]], 2) == [0]
    assert toxicity.cover([], 1) == []


def test_odd_rows_and_missing_labels(spark, odd, odd_texts, nothing):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (None, 1), (8, None), (5, 7)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    found = toxicity.score(odd, model).collect()
    assert len(found) == len(odd_texts) and all(0 <= r.score <= 1 for r in found)
    empty = toxicity.train(odd, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, empty).collect()} == {0.0}
    assert toxicity.score(nothing, model).count() == 0
