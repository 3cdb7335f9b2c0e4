import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from riskspark.llm import merkle

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """All levels, and for each leaf its (before, after) pairs from the bottom up."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + 16]) for i in range(0, len(last), 16)])
    paths = []
    for i in range(len(digests)):
        path = []
        for level in levels[:-1]:
            start = i // 16 * 16
            path.append(("".join(level[start:i]), "".join(level[i + 1:start + 16])))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    roots, below = [], []
    for source in order:
        own = sorted(trees[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, paths = climb([leaf(r) for r in own])
        roots.append(subroot)
        below.append((own, subroot, paths))
    root, tops = climb(roots)
    out = []
    for (own, subroot, paths), top in zip(below, tops):
        for row, path in zip(own, paths):
            folded = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                folded = leaf((*row[:4], lower(row[4])))
            for before, after in path + top:
                folded = h(before, folded, after)
            out.append((row[0], leaf(row), subroot, root, h(*(b + a for b, a in path + top)), folded, folded == root))
    return sorted(out, key=repr)


def collected(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")


@pytest.mark.parametrize("sizes", [(1,), (273, 1, 16, 17), tuple(range(1, 19))], ids=str)
def test_trees_of_every_shape(spark, sizes):
    rows = [(i * 7919 % 100_000, f"s{k}", "en", i, f"Text {i} of Ä") for k, n in enumerate(sizes) for i in range(n)]
    assert collected(merkle.verify(frame(spark, rows).repartition(5))) == brute(rows)


def test_odd_rows(odd):
    docs = odd.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "Über")).withColumn("n_chars", F.length("text"))
    docs = docs.withColumns({c: F.lit("clash") for c in ("tree", "pos", "size", "digest", "slot", "run", "before", "after", "path", "altered", "_row", "_at")})
    want = brute([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    got = collected(merkle.verify(docs))
    assert got == want
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_hot_tree_and_repeated_rows(spark):
    """One source with most rows, a third of all being one and the same row."""
    rows = [(5, "hot", None, 3, "Same")] * 700 + [(i, "hot", "en", 1, f"t{i}") for i in range(1200)] + [(i, None, "en", 1, "x") for i in range(40)]
    assert collected(merkle.verify(frame(spark, rows).repartition(7))) == brute(rows)


def test_any_change_breaks_the_root(spark):
    rows = [(i, f"s{i % 3}", "en", 4, "text") for i in range(60)]
    root = merkle.build(frame(spark, rows)).root
    assert root == merkle.build(frame(spark, rows[::-1])).root
    for other in [(9, "s0", "en", 4, "texT"), (9, "s0", None, 4, "text"), (9, "s1", "en", 4, "text"), (61, "s0", "en", 4, "text")]:
        assert merkle.build(frame(spark, [r if r[0] != 9 else other for r in rows])).root != root


def test_no_rows(nothing):
    docs = nothing.withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1))
    assert merkle.verify(docs).count() == 0
    assert merkle.build(docs).root is None
