import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(text):
    return np.frombuffer(bpe.codec(PATH).encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert bpe.codec(PATH).decode(bpe.codec(PATH).encode(text)) == text


@pytest.mark.parametrize("text", ["they'll we've  I'm", "aaaaaaaaaaaaaaab" * 400, "tabs\t\t x\n\n\n", "x<|endoftext|><|endoftext|>y", " 　  x", "١٢٣ ⅷ ½"])
def test_hard_texts(library, text):
    assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_decoding_broken_bytes_replaces_them(library):
    some = library.encode("é", add_special_tokens=False).ids + library.encode("漢", add_special_tokens=False).ids[:1]
    assert bpe.codec(PATH).decode(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)


def test_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 2)
    own = bpe.BytePairCodec(PATH)
    text = "one two three one two three four"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_odd_rows(odd, odd_texts, library):
    found = sorted(map(tuple, bpe.digests(bpe.encode_decode(odd, PATH)).collect()), key=repr)
    want = []
    for i, t in odd_texts:
        own = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(want, key=repr)


def test_no_rows(nothing):
    assert bpe.encode_decode(nothing, PATH).count() == 0
