"""Near-duplicate texts by the Jaccard similarity of their word shingles.

Texts with one set of shingles collapse to a class first. Candidates come in two ways, and every one is compared by its whole
set of shingles (hashes of 64 bits) before it links:

* Classes whose 64-bit fingerprints over the same shingles are equal or a few bits apart, by the pigeonring chains of ``simhash``.
* Fingerprints of a pair at 0.8 are some ten bits apart, up to about twenty, where pigeonring keys no longer tell it from
  unrelated texts. So each class also has ``BANDS`` keys of ``ROWS`` minima of its hashed shingles; two classes of similarity s
  share a key with chance 1 - (1 - s^ROWS)^BANDS, so a pair at 0.8 is missed with a chance of 4e-7.

First the fingerprints' links, and each member of a key with the key's least member, are compared, which joins most of a dense
cluster at a cost linear in its size. Then, where a key's members are still in several components, all members of different components are
compared in their task: products of shingle columns count what two texts share, and a spanning forest of the links comes
back, not the pairs. Keys over ``BLOCK`` members or ``BLOCK * USUAL`` shingles, as a common passage makes them, are cut into
blocks whose pairs are groups of their own. A pair within one component needs no comparison, as only connections count.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import simhash
from riskspark.llm.common import ASCII_LOWER, sized
from riskspark.llm.components import connected_components
from riskspark.session import materialise

WIDTH, SIMILARITY = 5, 0.8
ROWS, BANDS, BLOCK, USUAL = 4, 28, 1024, 256
#: Shingles hashed at once, so that a text of any length needs bounded memory beside its hashes.
SLICE = 1 << 12
FACTORS = np.random.default_rng(5).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes, width: int = WIDTH) -> set[bytes]:
    """Runs of ``width`` words of a UTF-8 text in lower case; a shorter text is one shingle, one without words the empty one."""
    words = data.translate(ASCII_LOWER).split()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def sketch(data: bytes, width: int = WIDTH) -> tuple[int, list[int], np.ndarray]:
    """A hash of the text's set of shingles, its keys, and the shingles' hashes in order."""
    hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, shingles(data, width)), np.uint64))
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), SLICE):
        # The upper half takes part in the product's lower bits too, so that all bits of a hash decide the order.
        part = hashes[at:at + SLICE]
        least = np.minimum(least, ((part ^ part >> np.uint64(32))[None, :] * FACTORS[:, None]).min(axis=1))
    signed = [xxhash.xxh64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return xxhash.xxh64_intdigest(hashes.tobytes()), signed, hashes


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [sketch(t or b"", width) for t in texts]
            prints = pa.array(np.fromiter((simhash.fingerprint(t or b"", width) for t in texts), np.uint64, len(texts)).view(np.int64))
            keys = pa.FixedSizeListArray.from_arrays(_signed([k for _, own, _ in found for k in own]), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed([c for c, _, _ in found]), keys, pa.array([len(h) for _, _, h in found], pa.int64()), prints], names=["doc_id", "cls", "keys", "size", "print"])

    return docs.mapInArrow(run, "doc_id long, cls long, keys array<long>, size long, print long")


def _hashes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sketch(t or b"", width) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([_signed([c for c, _, _ in found]), pa.array([h.view(np.int64) for _, _, h in found], pa.list_(pa.int64()))], names=["cls", "hashes"])


def shared_counts(owner: np.ndarray, hashes: np.ndarray, members: int) -> np.ndarray:
    """How many hashes each two of ``members`` sets share; ``owner`` is the set of each of ``hashes``."""
    _, column, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    both = counts[column] > 1  # what one set alone holds is never shared
    _, column = np.unique(column[both], return_inverse=True)
    owner, total = owner[both], np.zeros((members, members), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        own = slice(*np.searchsorted(column, [at, at + SLICE]))
        part = np.zeros((members, SLICE), np.float32)
        part[owner[own], column[own] - at] = 1
        total += part @ part.T
    return total


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that span every set of members connected by the symmetric matrix ``linked``."""
    links, free = [], np.ones(len(linked), bool)
    for seed in np.flatnonzero(linked.any(axis=1)):
        open_ = [seed] if free[seed] else []
        free[seed] = False
        while open_:
            node = open_.pop()
            new = np.flatnonzero(linked[node] & free)
            free[new] = False
            links += [(node, other) for other in new]
            open_ += new.tolist()
    return links


def _block_links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, a, b = batch.column(0), [], []
            flat, bounds = members.flatten(), np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))])
            cls, component, side = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for low, high in zip(bounds, bounds[1:]):
                own, sets = slice(low, high), flat.field(3).slice(low, high - low)
                apart = component[own][:, None] != component[own][None, :]
                if side[own].min() < side[own].max():
                    apart &= side[own][:, None] != side[own][None, :]
                if not apart.any():
                    continue
                sizes = sets.value_lengths().to_numpy(zero_copy_only=False)
                shared = shared_counts(np.repeat(np.arange(len(sizes)), sizes), sets.flatten().to_numpy(zero_copy_only=False), len(sizes))
                for x, y in forest(apart & (shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-3)):
                    a.append(cls[low + x])
                    b.append(cls[low + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _within(members: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: enough similar members of one key to connect all that are in different components.

    ``members``: ``key``, ``cls``, ``component``, ``hashes``, ``blocks`` (into how many blocks the key's members are cut).
    """
    spread = members.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = spread.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("cls", "component", "own", "hashes")).alias("members"))
    return groups.select("members").mapInArrow(_block_links(similarity), "a long, b long").distinct()


def _ring(owned: DataFrame, block: int) -> DataFrame:
    """``a``, ``b``: classes whose fingerprints link, enough to connect all that do. ``owned`` has ``cls``, ``print`` and ``doc_id``."""
    reps = materialise(owned.groupBy("print").agg(F.min("cls").alias("rep")), "prints")
    equal = owned.join(reps, "print").where("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b"))
    return simhash.links(reps, block).unionByName(equal).where("a <> b").distinct()


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) of classes whose similarity is at least ``similarity``."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def near_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, similarity: float = SIMILARITY,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, ``component_id`` (the smallest id of all texts connected by similar pairs).

    Null texts count as empty; texts without words are alike. Where all ids of a component are null, it is null. Other columns
    are ignored. No rows give no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    marked = materialise(_sketches(rows, width), "sketches")
    classes = marked.where("doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("size").alias("size"))
    keyed = materialise(classes.select("cls", "doc_id", "size", F.explode("keys").alias("key")), "keyed")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("least")).where("n > 1")
    members = materialise(keyed.join(shared.drop("n"), "key"), "members")
    # A class counts a shingle once, a fingerprint as often as it occurs, so one class may have several fingerprints.
    owned = materialise(marked.where("doc_id IS NOT NULL").groupBy("cls", "print").agg(F.min("doc_id").alias("doc_id")), "owned")
    ring = materialise(_ring(owned, block), "ring")
    ringed = owned.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(ring.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls")
    wanted = materialise(members.select("doc_id", "cls").unionByName(ringed).distinct(), "wanted")
    n = wanted.count()
    # An id may have several texts, so a text is told by its class as well.
    held = rows.join(sized(wanted.select("doc_id").distinct(), n), "doc_id", "left_semi").mapInArrow(
        lambda batches: _hashes(batches, width), "cls long, hashes array<long>")
    sets = materialise(held.join(sized(wanted.select("cls"), n), "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    stars = members.where("cls <> least").select(F.col("least").alias("a"), F.col("cls").alias("b"))
    linked = materialise(_compared(stars.unionByName(ring).distinct(), sets, similarity), "linked")
    found = connected_components(linked)
    placed = materialise(members.select("key", "cls", "size").join(found.withColumnRenamed("node", "cls"), "cls", "left").select(
        "key", "cls", "size", F.coalesce("component", "cls").alias("component")), "placed")
    parts = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / (block * USUAL))).alias("blocks")).where("low < high")
    open_ = placed.join(parts.select("key", "blocks"), "key").select("key", "cls", "component", "blocks")
    more = materialise(_within(open_.join(sets, "cls"), similarity), "more")
    joined = connected_components(linked.unionByName(more)).withColumnRenamed("node", "cls")
    owner = marked.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(joined, "cls", "left").select(
        "cls", "doc_id", F.coalesce("component", "cls").alias("component"))
    least = owner.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    component = owner.select("cls", "component").join(least, "component").select("cls", "component_id")
    return marked.select("doc_id", "cls").join(component, "cls").select(F.col("doc_id").alias(id_column), "component_id")
