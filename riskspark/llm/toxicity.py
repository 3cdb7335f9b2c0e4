"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one for ordinary and one for toxic text. Both hold
the words common in ordinary text; the toxic one also holds byte strings that occur in far more toxic than
ordinary documents (counted once per document), chosen so that each covers toxic documents no other does. Every text is cut into overlapping windows of two sizes;
a window that the toxic dictionary makes shorter than the ordinary one speaks for toxicity. A logistic
curve over the largest differences, fitted on labelled rows the dictionaries have not seen, calibrates
the score.

Training uses a bounded sample (``SAMPLE_ROWS`` of each label, chosen by a hash of the id); scoring is one
pass over whole texts without a shuffle.
"""

from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import ASCII_LOWER, logistic
from riskspark.session import materialise

#: Training rows of each label at most (about).
SAMPLE_ROWS = 5000
WINDOWS = ((64, 48), (40, 28))
GRAMS = range(5, 9)
COMMON_WORDS, OFFERED = 300, 2000
#: A segment must occur in so many times the share of toxic documents as of ordinary ones (and one more), by so many
#: standard errors, and in at least so many toxic documents (and such a part of them) that no earlier segment covers.
LIFT, ERRORS, LEAST, LEAST_SHARE = 8.0, 4.0, 3, 0.002
FLUSH = 400_000
#: Every window follows so many bytes from the start of both dictionaries, which become one match: without it a window
#: that barely shrinks would be stored as it is, and small differences lost.
LEAD = 64
#: Differences above this count as this.
TOP = 16.0


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


NOTHING = Model(b" ", b" ", (0.0,) * 7 + (-1e9,))


@cache
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=14, chain_log=14, search_log=6, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def windows(data: bytes, size: int, step: int) -> list[bytes]:
    """Overlapping windows over the whole of ``data``; the last one may be shorter."""
    if len(data) <= size:
        return [data]
    return [data[at:at + size] for at in range(0, len(data) - size + step, step)]


def features(data: bytes, model: Model) -> list[float]:
    """For each window size the largest difference of compressed lengths and the next one; and the log of the length."""
    data = data.translate(ASCII_LOWER)
    ordinary, toxic, lead = compressor(model.ordinary).compress, compressor(model.toxic).compress, model.ordinary[:LEAD]
    found = []
    for size, step in WINDOWS:
        gaps = sorted(len(ordinary(w)) - len(toxic(w)) for w in (lead + x for x in windows(data, size, step)))
        best = min(TOP, float(gaps[-1]))
        found += [best, min(TOP, float(gaps[-2])) if len(gaps) > 1 else 0.0, max(0.0, best - 5.0)]
    return [*found, float(np.log1p(len(data)))]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a byte string or a word: (kind, value, toxic, ordinary)."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        keys = list({**counts[0], **counts[1]})
        out = pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.binary()),
            pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
            names=["kind", "value", "toxic", "ordinary"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(text.translate(ASCII_LOWER).split())
            own = {(0, w) for w in words}
            for w in words:
                marked = b" " + w
                own.update((1, marked[i:i + n]) for n in GRAMS for i in range(len(marked) - n + 1))
            counts[label].update(own)
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield flush()
    yield flush()


def _features(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t or b"", model) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["key", "x"])


def _with_features(rows: DataFrame, key: str, model: Model) -> DataFrame:
    """``rows`` has ``key`` and the binary column ``_data``."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), "_data").mapInArrow(lambda b: _features(b, model), f"key {kind}, x array<double>")


def _holds(batches: Iterator[pa.RecordBatch], offered: list[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (b" " + b" ".join(t.translate(ASCII_LOWER).split()) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([[i for i, s in enumerate(offered) if s in t] for t in texts], pa.list_(pa.int32()))], names=["held"])


def cover(held: list[list[int]], least: float) -> list[int]:
    """Segments in the order in which each covers most of the documents that none before it covers, down to ``least``."""
    left: dict[int, set[int]] = {}
    for doc, own in enumerate(held):
        for i in own:
            left.setdefault(i, set()).add(doc)
    chosen = []
    while left:
        best = min(left, key=lambda i: (-len(left[i]), i))
        covered = left.pop(best)
        if len(covered) < least:
            break
        chosen.append(best)
        left = {i: rest for i, docs in left.items() if (rest := docs - covered)}
    return chosen


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``: 0 or 1).

    Rows with nulls, or without a partner, are left out. The sample is drawn from the labels, so only its rows' texts
    move. Without rows of both labels the score is 0 for every text.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return NOTHING
    share = {y: min(1.0, sample_rows / n) for y, n in sizes.items()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    chosen = known.where(part < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * 1_000_000)
    texts = docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    sample = materialise(
        texts.join(F.broadcast(chosen), "doc_id")  # at most about two samples of ids
        .withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(4))).dropDuplicates(["text", "toxic"]), "toxic")
    teach = sample.where("fold <> 0").select("text", "toxic")
    totals = {r["toxic"]: r["count"] for r in teach.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0) + 1, totals.get(0, 0) + 1
    counted = materialise(
        teach.mapInArrow(_segments, "kind int, value binary, toxic long, ordinary long").groupBy("kind", "value")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).where("toxic >= 3 OR ordinary >= 3"), "segments")
    common = [bytes(r["value"]) for r in counted.where("kind = 0").orderBy(F.desc("ordinary"), "value").limit(COMMON_WORDS).collect()]
    pooled = (F.col("toxic") + F.col("ordinary")) / (n1 + n0)
    errors = (F.col("toxic") / n1 - F.col("ordinary") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    ranked = counted.where((F.col("kind") == 1) & (F.col("toxic") >= max(LEAST, LEAST_SHARE * n1))).withColumn("errors", errors).where(
        (F.col("errors") > ERRORS) & (F.col("toxic") / n1 > LIFT * (F.col("ordinary") + 1) / n0)).orderBy(F.desc("errors"), F.desc(F.length("value")), "value")
    offered = [bytes(r["value"]) for r in ranked.limit(OFFERED).collect()]
    seen = teach.where("toxic = 1").select("text").mapInArrow(lambda b: _holds(b, offered), "held array<int>").collect()  # at most the sample
    chosen = [offered[i] for i in cover([r["held"] for r in seen], max(LEAST, LEAST_SHARE * n1))]
    # The last bytes of a dictionary are not searched, so filling follows.
    base, own = b" ".join(reversed(common)) + b" \x01", b"\x01".join(reversed(chosen)) + b"\x01" * 16
    model = Model(base + b"\x01" * len(own), base + own, ())
    taught = sample.where("fold = 0").select(F.struct("toxic").alias("label"), F.col("text").alias("_data"))
    rows = [(r["key"]["toxic"], r["x"]) for r in _with_features(taught, "label", model).collect()]  # at most the sample
    if not rows:
        return NOTHING
    y = np.array([r[0] for r in rows], float)
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    x = np.array([r[1] for r in rows], float).reshape(len(rows), 7)
    return model._replace(weights=tuple(logistic(x, y, weight / weight.mean()).tolist()))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1), ``gap`` (largest difference of compressed lengths).

    Null texts count as empty; an empty text has one empty window without a difference. Equal texts have equal
    scores. Other columns are ignored. No rows give no rows.
    """
    rows = docs.select(F.col(id_column), F.col(text_column).cast("string").cast("binary").alias("_data"))
    found = _with_features(rows, id_column, model)
    *slopes, intercept = model.weights
    linear = sum((F.col("x")[i] * w for i, w in enumerate(slopes)), F.lit(intercept))
    return found.select(F.col("key").alias(id_column), (1 / (1 + F.exp(-linear))).alias("score"), F.col("x")[0].alias("gap"))
