"""Byte-level BPE encoding by a priority queue over a doubly linked symbol list, and decoding.

Texts are cut into words by the vocabulary's pattern; each word's bytes form a linked list, and a heap
holds (rank, place) of every adjacent pair that can merge. A popped entry whose pair has changed since
is stale and skipped. A worker keeps the ids of recent words in a bounded table. Nothing is shuffled.
"""

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that byte-level vocabularies of this kind are used with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHED_WORDS = 400_000
#: Longer words are rare and not kept.
CACHED_LENGTH = 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


class BytePairCodec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        letters = byte_letters()
        self.base = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        back = {c: b for b, c in letters.items()}
        self.strings = [b""] * (max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in data["added_tokens"]}
        for t in data["added_tokens"]:
            self.strings[t["id"]] = t["content"].encode()
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word."""
        symbols = [self.base[b] for b in data]
        n = len(symbols)
        merges = self.merges
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << 20 | symbols[i + 1])
            if found:
                heap.append((found[0], i))
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = following[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get(symbols[i] << 20 | symbols[j])
            if not found or found[0] != rank:
                continue
            symbols[i], symbols[j] = found[1], -1
            k = following[i] = following[j]
            if k < n:
                previous[k] = i
                new = merges.get(symbols[i] << 20 | symbols[k])
                if new:
                    heapq.heappush(heap, (new[0], i))
            h = previous[i]
            if h >= 0:
                new = merges.get(symbols[h] << 20 | symbols[i])
                if new:
                    heapq.heappush(heap, (new[0], h))
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode()), "<u4").tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, word = self.known, self._word
        plain = lambda part: b"".join([known.get(w) or word(w) for w in self.words.findall(part)])
        if self.split_added is None or not any(t in text for t in self.added):
            return plain(text)
        return b"".join(self.added.get(part) or plain(part) for part in self.split_added.split(text))

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@cache
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``ids`` (binary, little-endian 32 bits each), ``decoded``.

    ``path`` names the vocabulary file, present on every worker. Null texts count as empty: no ids and an empty
    text. The strings of added tokens become those tokens. Other columns are ignored. No rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())],
                names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of the operator's rows."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
