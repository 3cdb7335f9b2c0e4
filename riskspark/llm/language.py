"""Language identification by unigram piece models with the segmentation summed out.

Pieces come from a fixed public vocabulary. A word (a run of letters, lower-cased, with the word mark in
front) has, for each language, the probability of all its segmentations together: the forward recursion
``alpha[i] = sum over pieces ending at i of alpha[start] * p(piece)``. Letters outside the vocabulary cost
one fixed piece. A text's score for a language is the product over its words; the posterior under equal
priors decides.

Training is expectation-maximisation: tasks count words, run forward and backward, and send expected
piece counts, at most vocabulary x languages numbers, whatever the corpus. Scoring is one pass without a
shuffle; a worker keeps the scores of recent words in a bounded table, as words repeat.
"""

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.session import materialise

#: Training rows for each language, chosen by a hash of the id: the documented bound of the sample.
SAMPLE_ROWS = 1500
ROUNDS = 3
SMOOTHING = 0.02
#: Runs up to this length are summed as plain products, which cannot underflow; longer ones with logarithms. The sums are the same.
PLAIN_LENGTH = 48
CACHED_WORDS = 400_000
MARK = "▁"
LETTERS, ONLY_LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
UNDETERMINED = "und"


@cache
def pieces(path: str) -> dict[str, int]:
    """Numbers of the vocabulary's usable pieces; number 0 is the piece for any other letter."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    kept = dict.fromkeys(p for p in usable if p == p.lower() and (p == MARK or p.lstrip(MARK).isalpha()) and p.count(MARK) <= 1)
    return {p: i for i, p in enumerate(kept, 1)}


def words(text: str) -> list[str]:
    """Letter runs in lower case, each with the word mark. Number signs that are no letters, like ``½``, belong to none."""
    lower = text.lower()
    found = LETTERS.findall(lower)
    if not all(map(str.isalpha, found)):
        found = ONLY_LETTERS.findall(lower)
    return [MARK + w for w in found]


def longest(known: dict[str, int]) -> int:
    """Length of the longest piece, which bounds how far back the recursion looks."""
    return max(map(len, known), default=1)


def arcs_to(group: list[str], end: int, known: dict[str, int], reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, piece numbers of each word from there to ``end``) for words of one length; -1 means no piece."""
    for start in range(max(0, end - reach), end):
        found = np.fromiter((known.get(w[start:end], -1) for w in group), np.int32, len(group))
        if end - start == 1:
            found[found < 0] = 0
        if (found >= 0).any():
            yield start, found


def lattice(group: list[str], length: int, known: dict[str, int], reach: int) -> list[tuple[int, int, np.ndarray]]:
    return [(start, end, found) for end in range(1, length + 1) for start, found in arcs_to(group, end, known, reach)]


def _by_length(own: list[str], limit: int = 4096) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(own):
        groups.setdefault(len(w), []).append(i)
    for places in groups.values():
        size = max(1, limit * PLAIN_LENGTH // max(PLAIN_LENGTH, len(own[places[0]])))
        for at in range(0, len(places), size):
            yield places[at:at + size]


def forward(own: list[str], known: dict[str, int], table: np.ndarray) -> np.ndarray:
    """log probability of each word in each language. ``table``: a row per piece and one of zeros at the end."""
    out, reach = np.empty((len(own), table.shape[1])), longest(known)
    for places in _by_length(own):
        group = [own[i] for i in places]
        length = len(group[0])
        if length > PLAIN_LENGTH:
            out[places] = _long_forward(group, known, table, reach)
            continue
        alpha = np.zeros((length + 1, len(group), table.shape[1]))
        alpha[0] = 1.0
        for start, end, found in lattice(group, length, known, reach):
            alpha[end] += alpha[start] * table[found]
        out[places] = np.log(np.maximum(alpha[length], 1e-300))
    return out


def _long_forward(group: list[str], known: dict[str, int], table: np.ndarray, reach: int) -> np.ndarray:
    """The same for long words of one length: only the last ``reach`` logarithms are held."""
    logs = [np.zeros((len(group), table.shape[1]))]
    for end in range(1, len(group[0]) + 1):
        last, at = logs[-1], end - len(logs)
        total = sum(np.exp(logs[start - at] - last) * table[found] for start, found in arcs_to(group, end, known, reach))
        logs.append(last + np.log(total))
        del logs[:-reach]
    return logs[-1]


def _long_expected(word: str, weight: np.ndarray, known: dict[str, int], table: np.ndarray, reach: int, counts: np.ndarray) -> None:
    """Adds one long word's expected piece counts: forward logarithms of all places, then backward with a window."""
    length, group = len(word), [word]
    front = np.zeros((length + 1, table.shape[1]))
    for end in range(1, length + 1):
        front[end] = front[end - 1] + np.log(sum(np.exp(front[start] - front[end - 1]) * table[found[0]] for start, found in arcs_to(group, end, known, reach)))
    # Logarithms of what follows a place. What a place still gets is gathered in a window, relative to the place after it.
    back = np.full((length + 1, table.shape[1]), -np.inf)
    back[length] = 0.0
    for end in range(length, 0, -1):
        for start, found in arcs_to(group, end, known, reach):
            chance = table[found[0]]
            with np.errstate(divide="ignore"):
                back[start] = np.logaddexp(back[start], back[end] + np.log(chance))
            counts[found[0]] += np.exp(front[start] + back[end] - front[length]) * chance * weight


def expected(own: list[str], weights: np.ndarray, known: dict[str, int], table: np.ndarray) -> np.ndarray:
    """Expected piece counts of each language; ``weights``: how often each word occurs in each."""
    counts, reach = np.zeros_like(table), longest(known)
    for places in _by_length(own):
        group, weight = [own[i] for i in places], weights[places]
        length = len(group[0])
        if length > PLAIN_LENGTH:
            for word, own_weight in zip(group, weight):
                _long_expected(word, own_weight, known, table, reach, counts)
            continue
        arcs = lattice(group, length, known, reach)
        alpha = np.zeros((length + 1, len(group), table.shape[1]))
        beta = np.zeros_like(alpha)
        alpha[0] = beta[length] = 1.0
        for start, end, found in arcs:
            alpha[end] += alpha[start] * table[found]
        for start, end, found in sorted(arcs, key=lambda a: -a[1]):
            beta[start] += beta[end] * table[found]
        share = weight / np.maximum(alpha[length], 1e-300)
        for start, end, found in arcs:
            np.add.at(counts, found, alpha[start] * table[found] * beta[end] * share)
    counts[-1] = 0
    return counts


def _table(counts: np.ndarray) -> np.ndarray:
    smooth = counts[:-1] + SMOOTHING
    return np.vstack([smooth / smooth.sum(axis=0), np.zeros(counts.shape[1])])


class Model:
    """Languages in order, and piece probabilities by language."""

    def __init__(self, languages: list[str], table: np.ndarray, path: str):
        self.languages, self.table, self.path = languages, table, path


class Scorer:
    """A model in a worker with its table of recent words."""

    def __init__(self, model: Model):
        self.model, self.known = model, pieces(model.path)
        self.places: dict[str, int] = {}
        self.logs = np.empty((0, len(model.languages)))

    def _places(self, own: list[str]) -> np.ndarray:
        known = self.places
        if len(known) > CACHED_WORDS:
            known.clear()
            self.logs = self.logs[:0]
        new = list({w for w in own if w not in known})
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.logs = np.vstack([self.logs, forward(new, self.known, self.model.table)])
        return np.fromiter(map(known.__getitem__, own), np.int64, len(own))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text; all texts of a batch share one call of the recursion."""
        split = [words(t) if t and self.model.languages else [] for t in texts]
        places = self._places([w for own in split for w in own])
        out, at = [], 0
        for own in split:
            if not own:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.logs[places[at:at + len(own)]].sum(axis=0)
            at += len(own)
            share = np.exp(total - total.max())
            best = int(share.argmax())
            out.append((self.model.languages[best], float(share[best] / share.sum())))
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for batch in batches:
        seen: dict[str, Counter] = {}
        for language, text in zip(*(c.to_pylist() for c in batch.columns)):
            seen.setdefault(language, Counter()).update(words(text or ""))
        rows = [(language, w, n) for language, own in seen.items() for w, n in own.items()]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from labelled rows (columns ``doc_id``, ``text``, ``lang``), nulls in ``lang`` left out."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((2, 0)), path)
    share = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, sample_rows / sizes[name]))))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    counted = materialise(
        chosen.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
        .groupBy("word").pivot("lang", languages).agg(F.sum("n")).na.fill(0), "words")
    known = pieces(path)
    table = _table(np.ones((len(known) + 2, len(languages))))
    for _ in range(rounds):
        model = Model(languages, table, path)

        def piece_counts(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            own_pieces, total = pieces(model.path), np.zeros_like(model.table)
            for batch in batches:
                weights = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(float)
                total += expected(batch.column(0).to_pylist(), weights, own_pieces, model.table)
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int64()), pa.array(language, pa.int64()), pa.array(total[piece, language])], names=["piece", "language", "n"])

        sums = counted.mapInArrow(piece_counts, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))
        fresh = np.zeros_like(table)
        found = sums.toPandas()  # at most vocabulary x languages rows
        fresh[found["piece"].to_numpy(), found["language"].to_numpy()] = found["n"].to_numpy()
        table = _table(fresh)
    return Model(languages, table, path)


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` (the posterior, 0 to 1).

    Texts and letter runs of any length are summed whole.
    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned.
    Ties go to the language first in order. Other columns are ignored. No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages numbers at most
    scorers: dict[int, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorers.setdefault(0, Scorer(sent.value))
        for batch in batches:
            found = scorer.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[id_column, "lang_pred", "score"])

    rows = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, lang_pred string, score double")

