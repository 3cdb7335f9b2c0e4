"""Corpus preparation over ``documents``: language, exact and near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of
``documents``. Rows are named by ``doc_id``: rows that share an id stay or go together, and rows without an id are never
dropped by a duplicate stage. Empty tables pass through as empty; other columns are carried along.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import exact, language, packing, pii, similar
from riskspark.llm.common import table, without
from riskspark.llm.queries import prepare
from riskspark.session import materialise

#: The posterior below which a text is in none of the languages learned.
LEAST_POSTERIOR = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and texts of no clear language.

    The languages are learned from the rows' own ``lang``; where no row has one, only texts without a letter go.
    """
    prepare(spark)
    model = language.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    found = language.identify(docs, model)
    rejected = (F.col("lang_pred") == language.UNDETERMINED) | (F.col("score") < LEAST_POSTERIOR)
    return without(docs, found.where(rejected).select("doc_id"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    prepare(spark)
    return without(docs, exact.exact_duplicates(docs).where(~F.col("kept")).select("doc_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by five-word shingles of similarity 0.8 or more the row with the smallest id stays.

    Candidates are the links of op2's fingerprints and pigeonring chains, here over five words, and those of a wider search;
    all are compared exactly.
    """
    prepare(spark)
    return without(docs, similar.near_texts(docs).where("component_id <> doc_id").select("doc_id"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span found by its kind in angle brackets; ``n_chars`` follows. Texts without a span stay as they are."""
    prepare(spark)
    found = pii.detect(docs, keep=tuple(docs.columns))
    text = pii.redacted(F.col("row.text"))
    fields = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(text == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return found.select(*(fields[c].alias(c) for c in docs.columns))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``bucket``, ``bound``, ``batch``, ``slot``."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language), ("exact_dedup", drop_exact_duplicates), ("near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data), ("packing", pack_batches),
]
#: SQL has no 64-bit hash with a seed, no expectation-maximisation and no dynamic program; see the tests for brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared scratch folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
