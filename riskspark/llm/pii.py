"""Personal data by weak supervision, with DataFrame operations only.

Base spans come from fixed patterns and checks and always stay. Further candidates (key-like strings and number
runs outside the base spans) are voted on by labelers: patterns, gazetteers of cue words, and context. Votes over
*all* documents are counted by vote pattern; as a pattern is a handful of small numbers, the table of counts is
small whatever the corpus. Expectation-maximisation over it estimates how reliable each labeler is, and a logistic
span classifier is trained on the resulting labels, using shape features beside the votes. Its weights become a
column expression that decides every candidate.

Offsets are code points: pieces between matches (``split``) and the matches (``regexp_extract_all``) alternate, so
running lengths give every start and end. Patterns are written possessively, and start only where a run starts, so
long runs cost linear time.
"""

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import logistic, whole
from riskspark.session import materialise

#: The patterns' meaning is given; see the module's text for their form.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Candidates beyond the base kinds, in the order of their spans.
KEY = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+"
NUMBER = r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?(?:[\x20.-]{1,2}[0-9]{2,4}){1,4}(?![0-9A-Za-z])"
EXTRA = ("secret", "number")
CONTEXT = 28
#: Gazetteers of cue words in the four languages.
KEY_CUES = "token|key|secret|password|passwd|pwd|api|auth|bearer|credential|schlüssel|passwort|clave|contraseña|clé|mot de passe"
NUMBER_CUES = "phone|tel|fax|call|mobile|cell|ssn|passport|account|telefon|handy|konto|teléfono|móvil|cuenta|téléphone|portable|compte"


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<start, end, value, left, right>> of all matches; empty where ``guard`` is false."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        F.slice(pieces, 1, F.size(found)), found,
        lambda before, value: F.struct(before.alias("before"), value.alias("value")))
    after = F.slice(pieces, 2, F.size(found))
    triples = F.zip_with(pairs, after, lambda p, right: F.struct(p["before"].alias("before"), p["value"].alias("value"), F.substring(right, 1, CONTEXT).alias("right")))
    kind = "array<struct<start:int,end:int,value:string,left:string,right:string>>"

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["before"])
        end = start + F.length(t["value"])
        span = F.struct(start.alias("start"), end.alias("end"), t["value"].alias("value"), F.right(t["before"], F.lit(CONTEXT)).alias("left"), t["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    return F.when(guard, F.aggregate(triples, start, add, lambda s: s["spans"])).otherwise(F.array().cast(kind))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    size = F.length(digits(value))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return size.between(13, 19) & F.when(size.between(13, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind in order of their start."""
    numeric = text.rlike("[0-9]")
    guards = {"email": F.contains(text, F.lit("@")), "ip": numeric, "card": numeric, "phone": F.contains(text, F.lit("+"))}
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))

    def spans(kind: str) -> Column:
        passing = F.filter(matches(text, patterns[kind], guards[kind]), lambda m: valid(kind, m["value"]))
        return F.transform(passing, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))

    return {k: spans(k) for k in KINDS}


class Labeler(NamedTuple):
    """``vote`` is 1, 0 (abstains) or -1 from value, left and right context."""

    name: str
    vote: object


def _yes(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _no(condition: Column) -> Column:
    return F.when(condition, -1).otherwise(0)


def _cue(left: Column, words: str) -> Column:
    return left.rlike(rf"(?i)(?:^|[^\p{{L}}])(?:{words})[^\p{{L}}]{{0,6}}$")


LABELERS = {
    "secret": (
        Labeler("pattern_prefix", lambda v, left, right: _yes(v.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|sk-|pk-|xox[bp]-|AIza)"))),
        Labeler("pattern_hex", lambda v, left, right: _yes(v.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") & v.rlike("[0-9]") & v.rlike("[A-Fa-f]"))),
        Labeler("gazetteer_cue", lambda v, left, right: _yes(_cue(left, KEY_CUES))),
        Labeler("context_quotes", lambda v, left, right: _yes(left.rlike("[=:]\\s*[\"']?$") & v.rlike("[0-9]"))),
        Labeler("pattern_mixed", lambda v, left, right: F.when(v.rlike("[0-9].*[0-9].*[0-9]") & v.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]") & ~v.rlike("[/+_-].*[/+_-].*[/+_-]"), 1).otherwise(-1)),
        Labeler("pattern_word", lambda v, left, right: _no(v.rlike("^[A-Za-z/_+-]*$") | v.rlike("^[0-9/_+-]*$"))),
    ),
    "number": (
        Labeler("pattern_phone", lambda v, left, right: F.when(v.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"), 1).otherwise(-1)),
        Labeler("pattern_identity", lambda v, left, right: _yes(v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))),
        Labeler("gazetteer_cue", lambda v, left, right: _yes(_cue(left, NUMBER_CUES))),
        Labeler("context_unit", lambda v, left, right: _no(right.rlike(r"^\s?(?:%|€|\$|kg|km|cm|mm|am|pm|Uhr)"))),
        Labeler("pattern_date", lambda v, left, right: _no(v.rlike(r"^(?:(?:19|20)[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{2}|[0-9]{2}[ .-][0-9]{2}[ .-](?:19|20)[0-9]{2})$"))),
    ),
}


def shape(value: Column) -> Column:
    """A small number for length and share of digits: 0 to 11."""
    size, numeric = F.length(value), F.length(digits(value))
    return F.when(size < 20, 0).when(size < 32, 1).when(size < 48, 2).otherwise(3) * 3 + F.when(numeric * 3 < size, 0).when(numeric * 3 < size * 2, 1).otherwise(2)


def candidates(text: Column, taken: Column) -> dict[str, Column]:
    """Candidates of each further kind that overlap no span of ``taken``, with votes and shape."""
    guards = {"secret": text.rlike("[A-Za-z0-9_+/-]{16}"), "number": text.rlike("[0-9]")}
    patterns = {"secret": KEY, "number": NUMBER}

    def voted(kind: str) -> Column:
        free = F.filter(matches(text, patterns[kind], guards[kind]), lambda m: ~F.exists(taken, lambda t: (t["start"] < m["end"]) & (m["start"] < t["end"])))
        return F.transform(free, lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"),
            F.array(*[lab.vote(m["value"], m["left"], m["right"]) for lab in LABELERS[kind]]).alias("votes"), shape(m["value"]).alias("shape")))

    return {k: voted(k) for k in EXTRA}


def log_odds(votes: tuple[int, ...], share: float, accuracy: list[float]) -> float:
    """Evidence for a positive span: the prior and the labelers that vote; an abstention says nothing."""
    return math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], labelers: int, rounds: int = 200) -> tuple[float, list[float]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of positives and each labeler's accuracy where it votes. Labelers are taken as independent
    given the truth and, before any data, as right four times in five.
    """
    share, accuracy = 0.5, [0.8] * labelers
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        belief = [sigmoid(log_odds(v, share, accuracy)) for v, _ in patterns]
        share = (sum(b * n for b, (_, n) in zip(belief, patterns)) + 1) / (total + 2)
        fresh = []
        for i in range(labelers):
            right = sum(n * (b if v[i] > 0 else 1 - b) for b, (v, n) in zip(belief, patterns) if v[i])
            voted = sum(n for v, n in patterns if v[i])
            fresh.append(min(0.999, max(0.5, (right + 8) / (voted + 10))))
        moved = max(abs(a - b) for a, b in zip(accuracy, fresh))
        accuracy = fresh
        if moved < 1e-9:
            break
    return share, accuracy


def _inputs(votes: tuple[int, ...], shape_: int) -> list[float]:
    return [*map(float, votes), *(float(shape_ // 3 == k) for k in range(4)), *(float(shape_ % 3 == k) for k in range(3))]


def classifier(rows: list[tuple[tuple[int, ...], int, float]], labels: list[float]) -> list[float]:
    """Weights of the logistic span classifier, intercept first; ``rows`` are (votes, shape, count), labels soft."""
    if not rows:
        return []
    inputs, counts = np.array([_inputs(v, s) for v, s, _ in rows]), np.array([n for _, _, n in rows])
    *slopes, intercept = logistic(inputs, np.array(labels), counts, ridge=0.1).tolist()
    return [intercept, *slopes]


class Model(NamedTuple):
    """Classifier weights of each further kind; no weights mean that no candidate was seen."""

    weights: dict[str, list[float]]
    accuracy: dict[str, list[float]]


def fit(found: DataFrame) -> Model:
    """Reliabilities and classifiers from the vote counts of ``found`` (one row per document)."""
    weights, accuracy = {}, {}
    for kind in EXTRA:
        counted = found.select(F.explode(kind).alias("c")).groupBy("c.votes", "c.shape").count().orderBy("votes", "shape").collect()
        rows = [(tuple(r["votes"]), r["shape"], float(r["count"])) for r in counted]
        share, accuracy[kind] = reliabilities([(v, n) for v, _, n in rows], len(LABELERS[kind]))
        weights[kind] = classifier(rows, [sigmoid(log_odds(v, share, accuracy[kind])) for v, _, _ in rows])
    return Model(weights, accuracy)


def accepted(kind: str, model: Model) -> Column:
    """The spans of a further kind that the classifier keeps."""
    weights = model.weights[kind]
    none = F.array().cast("array<struct<start:int,end:int>>")
    if not weights:
        return none
    n = len(LABELERS[kind])

    def odds(c: Column) -> Column:
        votes = reduce(lambda a, i: a + c["votes"][i] * weights[1 + i], range(n), F.lit(weights[0]))
        size = F.element_at(F.array(*map(F.lit, weights[n + 1:n + 5])), F.floor(c["shape"] / 3).cast("int") + 1)
        return votes + size + F.element_at(F.array(*map(F.lit, weights[n + 5:])), c["shape"] % 3 + 1)

    return F.transform(F.filter(kind, lambda c: odds(c) > 0), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))


def detect(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``row`` (a struct of the columns ``keep``), and arrays of (start, end) spans for each base
    and further kind, ``span_<kind>``.

    Null texts count as empty and have no spans. Spans of one kind are disjoint and ascending; base kinds may overlap
    each other, further kinds overlap no base span. Equal texts get equal spans. As kept columns are in a struct, their
    names clash with nothing. No rows give no rows.
    """
    base = docs.select(F.struct(*keep).alias("row"), whole(text_column).alias("text"))
    base = base.select("row", "text", *(c.alias(f"span_{k}") for k, c in base_spans(F.col("text")).items()))
    taken = F.concat(*(F.col(f"span_{k}") for k in KINDS))
    found = materialise(base.select("row", *(f"span_{k}" for k in KINDS), *(c.alias(k) for k, c in candidates(F.col("text"), taken).items())), "spans")
    model = fit(found)
    return found.select("row", *(f"span_{k}" for k in KINDS), *(accepted(k, model).alias(f"span_{k}") for k in EXTRA))


def _texts(kinds: tuple[str, ...]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(f"span_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.concat_ws(",", F.concat(*map(named, kinds)))


def report(spans: DataFrame) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256`` and ``spans`` from the operator's rows."""
    return spans.select(
        "row.doc_id", *(F.size(f"span_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_texts(KINDS), 256).alias("base_sha256"), _texts(KINDS + EXTRA).alias("spans"))


def redacted(text: Column) -> Column:
    """``text`` (null stays null) with every span replaced by its kind in angle brackets; of overlapping spans the first names the kind."""
    def marks(kind: str) -> Column:
        return F.transform(f"span_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("mark")))

    named = F.concat(*map(marks, KINDS + EXTRA))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, s: Column) -> Column:
        fresh = F.concat(state["parts"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), s["mark"]))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["parts"]).alias("parts"))

    whole_text = F.aggregate(F.array_sort(named), start, add, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(named) > 0, whole_text).otherwise(text)
