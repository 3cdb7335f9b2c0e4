import pytest

from riskspark.llm.queries import prepare

#: Names that operators use inside themselves, here as columns of the input.
CLASHING = ["row", "key", "rep", "print", "data", "n", "_text", "_id", "bucket", "component", "span_email", "words", "keep_id"]
LONG = "Word after word, 12.34.56.78 and on. " * 1500


@pytest.fixture(scope="session", autouse=True)
def ready(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def odd_texts():
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "same text here to copy"), (5, "same text here to copy"), (5, "same text here to copy"),
        (6, LONG), (7, "naïve Ünïcode ß 漢字 🙂 é"), (8, "a" * 5000), (9, "1 2 3 4 5"), (10, None), (None, "no id at all here"),
        (11, "x@y.zz, +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.1"), (12, "<|endoftext|> tail"), (13, "\x00 zero \x1c sep \x85 next line"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    rows = [(i, t, ["en", None][(i or 0) % 2], *("clash" for _ in CLASHING)) for i, t in odd_texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(4)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
