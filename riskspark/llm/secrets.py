"""Secrets in texts: fixed patterns, and values in a credential context that are costly to guess.

How costly is told by a dynamic program over the value's characters: the least decimal logarithm of guesses over all
ways to cut the value into ranked words, dates, repeats, keyboard walks and brute-force spans. A span pays for the choice of its
kind and for the choices within it, so placeholders, phrases, dates and walks stay cheap and random strings do not.
Words are those of a public vocabulary, ranked by its order. Every value is measured whole, in time proportional to
its length. Texts are read by Arrow batches; nothing is shuffled.
"""

import json
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns, their flags inline, with the group that is measured and the least length it must have.
BASE = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    # Runs are maximal either way, so a least count finds what filtering all runs by length would.
    "hex": (re.compile("[0-9a-f]{24,}"), 0, 24),
}
KINDS = (*BASE, "guess")
_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|(?:access|private|secret|account)[_ -]?key|credentials?|(?<![a-z])(?:login|pin))(?![a-z0-9])"
_BARE = r"""[^\s"'`<>,;]*[^\s"'`<>,;.!?)\]]"""
#: Credential contexts; the last group that took part is the value. After a bare "is" it must hold a digit, as prose goes on with words.
CONTEXTS = (
    re.compile(f"(?ai){_NAME}" + r"""["'\]]{0,2}(?:[ \t]{0,8}(?:=>|->|:=|[:=])[ \t]{0,8}|[ \t]{1,8}(?:is[ \t]{1,8})?(?=["'`]))""" + rf"""(?:"([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`|({_BARE}))"""),
    re.compile(f"(?ai){_NAME}" + rf"[ \t]{{1,8}}is[ \t]{{1,8}}(?=[^\s\d]{{0,64}}\d)({_BARE})"),
    re.compile(r"(?ai)\b(?:bearer|basic)[ \t]{1,8}([a-z0-9+/_.=~-]+)"),
    re.compile(r"://[^\s/:@]{0,256}:([^\s/@]+)@"),
)
#: A text without any of these, in lower case, has no context.
MARKS = ("pass", "pwd", "secret", "token", "key", "credential", "login", "pin", "bearer", "basic", "://")
#: Shorter values are not measured.
LEAST_LENGTH = 6
#: A value is a secret from so many guesses on, as a power of ten.
LEAST_LOG10 = 8.0
#: It also needs so much for each character: phrases of words cost less, random strings more.
LEAST_RATE = 1.0

#: The choice of a span's kind.
KIND = math.log10(5)
#: Repeats copy what stands 1 to so many characters before; a repeat pays for this distance and for its length.
DISTANCES = 32
REPEAT = KIND + math.log10(DISTANCES) + math.log10(64)
#: A walk pays for its first key, and for each further one whether it goes straight on or which way it turns.
FIRST_KEY, STRAIGHT, TURN = KIND + math.log10(94), math.log10(2), math.log10(2 * 6)
YEARS = 200
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
#: Dates with or without a separator, and years alone, each with its choices.
DATES = tuple((re.compile(f"(?a){pattern}"), KIND + math.log10(choices)) for pattern, choices in (
    (f"{_DAY}([-/._ ]?){_MONTH}\\1{_YEAR}", 366 * YEARS * 6), (f"{_MONTH}([-/._ ]?){_DAY}\\1{_YEAR}", 366 * YEARS * 6),
    (f"{_YEAR}([-/._ ]?){_MONTH}\\1{_DAY}", 366 * YEARS * 6), (_YEAR, YEARS)))
#: Letters that digits and signs stand for in words.
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_SHIFTED = ("~!@#$%^&*()_+", " QWERTYUIOP{}|", " ASDFGHJKL:\"", " ZXCVBNM<>?")
KEYS = {c: (x, y) for rows in (_ROWS, _SHIFTED) for y, row in enumerate(rows) for x, c in enumerate(row) if c != " "}
#: Ways from a key to a neighbour: rows lean, so each row's keys lie between those of the row above.
WAYS = {(-1, 0), (1, 0), (0, -1), (1, -1), (0, 1), (-1, 1)}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    log10_guesses: float


def brute_force(c: str) -> float:
    """Cost of one character among its like."""
    if c.isascii():
        return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return 2.0


def word_cost(written: str, words: dict[str, int]) -> float | None:
    """Cost of a word by its rank, its capitals and its letters written otherwise; None if it is no word."""
    lower = written.lower()
    rank, swapped = words.get(lower), 0
    if rank is None:
        plain = lower.translate(LEET)
        rank = words.get(plain) if plain != lower else None
        if rank is None:
            return None
        swapped = sum(a != b for a, b in zip(plain, lower))
    capitals = sum(c.isupper() for c in written)
    if capitals == 0:
        cased = 0.0
    elif capitals == len(written) or (capitals == 1 and written[0].isupper()):
        cased = math.log10(2)
    else:
        cased = len(written) * math.log10(2)
    return KIND + math.log10(rank) + cased + swapped * math.log10(2)


def way(a: str, b: str) -> tuple[int, int] | None:
    """The step from key ``a`` to ``b`` if they are neighbours."""
    if a not in KEYS or b not in KEYS:
        return None
    step = (KEYS[b][0] - KEYS[a][0], KEYS[b][1] - KEYS[a][1])
    return step if step in WAYS else None


def log10_guesses(value: str, words: dict[str, int], longest: int) -> float:
    """The least log10 of guesses over all segmentations of ``value``; ``longest`` is the longest word's length. Zero if empty."""
    n = len(value)
    best = [0.0] + [math.inf] * n
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, c in enumerate(value):
        if "0" <= c <= "9":
            for pattern, cost in DATES:
                found = pattern.match(value, start)
                if found:
                    ending[found.end()].append((start, cost))
    brute = walk = math.inf
    #: By distance: the least cost before the run of equal characters that ends here, at any place in the run.
    copied = [math.inf] * (DISTANCES + 1)
    before = None
    for i in range(1, n + 1):
        c = value[i - 1]
        brute = min(brute, best[i - 1] + KIND) + brute_force(c)
        least = brute
        step = way(value[i - 2], c) if i > 1 else None
        if step:
            walk = min(walk + (STRAIGHT if step == before else TURN), best[i - 2] + FIRST_KEY + TURN)
            least = min(least, walk)
        else:
            walk = math.inf
        before = step
        for d in range(1, min(DISTANCES, i - 1) + 1):
            if c == value[i - 1 - d]:
                copied[d] = min(copied[d], best[i - 1])
                least = min(least, copied[d] + REPEAT)
            else:
                copied[d] = math.inf
        for start, cost in ending[i]:
            least = min(least, best[start] + cost)
        for start in range(max(0, i - longest), i):
            cost = word_cost(value[start:i], words)
            if cost is not None:
                least = min(least, best[start] + cost)
        best[i] = least
    return best[n]


@cache
def ranked_words(path: str) -> tuple[dict[str, int], int]:
    """Whole words of at least three letters in the vocabulary file, ranked from 1 by their ids, and the longest one's length."""
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    end = "</w>"
    plain = [t[: -len(end)] for t in sorted(vocab, key=vocab.get) if t.endswith(end)]
    words = {w: 0 for w in plain if len(w) >= 3 and w.isalpha()}
    return {w: rank for rank, w in enumerate(words, 1)}, max(map(len, words), default=0)


class Scanner:
    """Finds the spans of one text after another; the costs of recent values are kept."""

    def __init__(self, path: str, least: float):
        self.words, self.longest = ranked_words(path)
        self.least = least
        self.known: dict[str, float] = {}

    def cost(self, value: str) -> float:
        if value not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            found = log10_guesses(value, self.words, self.longest)
            if len(value) > 200:
                return found
            self.known[value] = found
        return self.known[value]

    def base(self, text: str) -> list[Span]:
        return [
            Span(kind, *m.span(), self.cost(m.group(group)))
            for kind, (pattern, group, least) in BASE.items() for m in pattern.finditer(text) if len(m.group(group)) >= least]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Values in a context that cost enough and touch neither a base span nor each other; earlier and longer ones first."""
        lower = text.lower()
        if not any(mark in lower for mark in MARKS):
            return []
        values = sorted({m.span(m.lastindex) for pattern in CONTEXTS for m in pattern.finditer(text)}, key=lambda s: (s[0], -s[1]))
        starts = sorted(s.start for s in base)
        ends = list(accumulate((s.end for s in sorted(base, key=lambda s: s.start)), max))
        found, reached = [], 0
        for start, end in values:
            before = bisect_left(starts, end)
            if end - start < LEAST_LENGTH or start < reached or (before and ends[before - 1] > start):
                continue
            cost = self.cost(text[start:end])
            if cost >= max(self.least, LEAST_RATE * (end - start)):
                found.append(Span("guess", start, end, cost))
                reached = end
        return found

    def spans(self, text: str) -> list[Span]:
        base = self.base(text)
        return sorted(base + self.added(text, base), key=lambda s: (s.start, KINDS.index(s.kind)))


def find_secrets(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST_LOG10) -> DataFrame:
    """One row per input row: id and ``spans`` (kind, start, end in code points, log10_guesses of the value), by start, then kind.

    Kinds are the base patterns ``assign``, ``access``, ``hex``, which always stay, and ``guess``: a value in a credential context
    that needs 10 ** ``least`` guesses or more, ``LEAST_RATE`` powers of ten for each character, and overlaps no base span. ``vocabulary`` is a path that every worker has. A null
    text counts as empty and has no spans; texts of any length are read whole; repeated rows are read alike; null ids are kept;
    other columns are ignored; no rows give no rows.
    """
    schema = f"id {docs.schema[id_column].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,log10_guesses:double>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(vocabulary, least)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())]))
        for batch in batches:
            found = [[s._asdict() for s in scanner.spans(text.as_py() or "")] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_column)


def report(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and digests of ``find_secrets``: ``n_assign``, ``n_access``, ``n_hex``, ``n_guess``, ``base_sha256``, ``spans``."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(id_column, *(counted(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
