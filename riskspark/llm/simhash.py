"""Near-duplicate search on 64-bit similarity fingerprints with pigeonring filtering.

The 64 bits form a ring of eight segments. If two fingerprints differ in at most three bits, some
segment starts a chain whose first l segments differ in at most 3 l / 8 bits, for every l from 1 to 8
(rounded down: 0 0 1 1 1 2 2 3). So the first two segments agree, and of the next 24 bits at most one
differs, hence one half of them agrees. That gives 16 keys of 28 bits for each *distinct* fingerprint.
Fingerprints with a common key are compared: the chain budgets are checked segment by segment first,
and only what passes meets the full Hamming distance.

Copies of a fingerprint collapse before the search. Buckets over ``BLOCK`` members are cut into blocks
and pairs of blocks become groups of their own, so no task holds a whole hot bucket; each group returns
a spanning forest of its links instead of all pairs, which loses no connection.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import ASCII_LOWER
from riskspark.llm.components import connected_components
from riskspark.session import materialise

SHINGLE, DISTANCE, SEGMENTS, BLOCK = 3, 3, 8, 2048
#: Bits counted at once, so that a text of any length needs bounded memory.
SLICE = 1 << 15
BUDGETS = [DISTANCE * length // SEGMENTS for length in range(1, SEGMENTS + 1)]


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text; a text without words has fingerprint zero."""
    words = data.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - width].tolist(), ends[width - 1:].tolist()
    totals = np.zeros(64, np.int64)
    for at in range(0, len(starts), SLICE):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + SLICE], ends[at:at + SLICE])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * totals > len(starts), bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t or b"") for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``print`` (the fingerprint as a signed 64-bit number) of every row."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, print long")


def _keys() -> list:
    keys = []
    for start in range(SEGMENTS):
        shift = 8 * start
        turned = F.shiftrightunsigned("print", shift).bitwiseOR(F.shiftleft("print", 64 - shift)) if shift else F.col("print")
        for half in range(2):
            own = F.shiftrightunsigned(turned, 16 + 12 * half).bitwiseAND(F.lit(0xFFF))
            low = turned.bitwiseAND(F.lit(0xFFFF))
            keys.append(F.lit((2 * start + half) << 28).bitwiseOR(F.shiftleft(own, 16)).bitwiseOR(low))
    return keys


def _masks() -> np.ndarray:
    """Masks of the first l segments from each start."""
    ring = [0xFF << (8 * s) for s in range(SEGMENTS)]
    return np.array([[sum(ring[(start + k) % SEGMENTS] for k in range(length)) for length in range(1, SEGMENTS + 1)]
                     for start in range(SEGMENTS)], np.uint64)


MASKS = _masks()


def near(differing: np.ndarray, start: int) -> np.ndarray:
    """Positions of ``differing`` (xor of two fingerprints) that keep every chain budget from ``start``.

    The last chain is the whole ring, so what is left is within the Hamming distance.
    """
    left = np.arange(len(differing))
    for length, budget in enumerate(BUDGETS):
        left = left[np.bitwise_count(differing[left] & MASKS[start, length]) <= budget]
    return left


def forest(prints: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that span every set of fingerprints connected within this group."""
    links, open_ = [], np.arange(len(prints))
    while len(open_):
        frontier, open_ = [open_[0]], open_[1:]
        while frontier and len(open_):
            node = frontier.pop()
            hit = near(prints[open_] ^ prints[node], start)
            if len(hit):
                found = open_[hit]
                links += [(node, other) for other in found]
                frontier += found.tolist()
                open_ = np.delete(open_, hit)
    return links


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        starts = batch.column(0).to_pylist()
        members = batch.column(1)
        flat, offsets = members.flatten(), np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))])
        prints, ids = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64), flat.field(1).to_pylist()
        for row, start in enumerate(starts):
            at = offsets[row]
            for x, y in forest(prints[at:offsets[row + 1]], start):
                a.append(ids[at + x])
                b.append(ids[at + y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: ids of linked fingerprints, enough to connect all that are linked.

    ``classes`` has ``print`` (distinct) and ``rep``.
    """
    keyed = classes.select("print", "rep", F.explode(F.array(*_keys())).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block)).drop("count")
    member = keyed.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")))
    spread = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = spread.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("print", "rep")).alias("members"))
    start = F.shiftright("key", 29).cast("int").alias("start")
    return groups.where(F.size("members") > 1).select(start, "members").mapInArrow(_link_batches, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Null texts count as empty and have fingerprint zero like any text without words; they link like any
    other. Rows with one id and different texts are linked through each text's fingerprint. Where all ids of
    a fingerprint are null, its component is null. Other columns are ignored. No rows give no rows.
    """
    marked = materialise(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = materialise(marked.groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    found = connected_components(links(classes.where("rep IS NOT NULL"), block))
    component = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "print", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(component, "print").select(
        F.col("doc_id").alias(id_column), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
