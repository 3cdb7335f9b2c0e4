import random
import re

import numpy as np
import pytest
import xxhash

from riskspark.llm import simhash
from tests.llm.test_components import brute as components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    return [(ids[k], ids[k + 1 + int(j)]) for k in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(values[k + 1:] ^ values[k]) <= 3)]


def test_fingerprint(odd_texts):
    for _, text in odd_texts:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text or "")


def test_every_pair_within_three_bits_has_a_key_and_passes_its_chain():
    rng = random.Random(1)
    for _ in range(4000):
        differing = np.array([sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))], np.uint64)
        turned = [int(differing[0]) >> 8 * s | int(differing[0]) << (64 - 8 * s) & (1 << 64) - 1 for s in range(8)]
        shared = [s for s in range(8) if turned[s] & 0xFFFF == 0 and (turned[s] >> 16 & 0xFFF == 0 or turned[s] >> 28 & 0xFFF == 0)]
        assert any(len(simhash.near(differing, s)) for s in shared)


@pytest.mark.parametrize("block", [4, 2048])
def test_links_connect_what_brute_force_connects(spark, block):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {i: b for i, b in enumerate(base)}
    for i in range(60, 500):  # balls of near fingerprints, one of them large
        centre = base[0] if i % 3 == 0 else rng.choice(base)
        prints[i] = centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    prints = {rep: value for value, rep in {v: k for k, v in prints.items()}.items()}
    signed = [(v - (1 << 64) if v >> 63 else v, k) for k, v in prints.items()]
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed, "print long, rep long"), block).collect()]
    assert components(found) == components(linked(prints))


def test_odd_rows(odd, odd_texts):
    prints = {}
    for i, t in odd_texts:
        prints.setdefault(plain_fingerprint(t or ""), []).append(i)
    found = simhash.near_duplicates(odd)
    assert found.count() == len(odd_texts)
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in found.collect()}
    least = {p: min(x for x in own if x is not None) for p, own in prints.items() if any(x is not None for x in own)}
    joined = components(linked({v: k for k, v in least.items()}))
    for i, t in odd_texts:
        p = plain_fingerprint(t or "")
        rep = least.get(p)
        assert rows[i, f"{p:016x}"] == joined.get(rep, rep)


def test_no_rows(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
