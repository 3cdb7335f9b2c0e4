"""Registered queries of the corpus operators, with SQL twins where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, descent, exact, language, merkle, mixing, packing, pii, redirects, secrets, simhash, toxicity, whitening
from riskspark.llm.common import remainder, ship, table
from riskspark.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Adaptive plans, Arrow batches that stay small when texts are long, and this package on all workers."""
    tune(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def query(sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


@query()
def op2_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query(exact.SQL)
def op6_exact_dedup(spark, sf):
    return exact.exact_duplicates(table(spark, sf, "documents"))


@query()
def op10_bpe(spark, sf):
    return bpe.digests(bpe.encode_decode(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query()
def op7_language(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = language.train(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return language.identify(docs, model).withColumn("held_out", held_out)


@query()
def op1_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = remainder("doc_id", 3) == 1
    model = toxicity.train(docs.where(~held_out), table(spark, sf, "labels").where(~held_out))
    return toxicity.score(docs, model).withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query(redirects.SQL)
def op9_redirects(spark, sf):
    return redirects.judge(table(spark, sf, "pages"))


@query()
def op5_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query()
def op3_pii(spark, sf):
    return pii.report(pii.detect(table(spark, sf, "documents")))


@query()
def op4_context_mixing(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", remainder("doc_id", 7) == 2)
    return mixing.score(docs, "held_out")


@query()
def op8_descent(spark, sf):
    return descent.near_vectors(table(spark, sf, "embeddings"))


@query(merkle.SQL)
def op11_merkle(spark, sf):
    return merkle.verify(table(spark, sf, "documents"))


@query()
def op12_guess_cost(spark, sf):
    return secrets.report(secrets.find_secrets(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query()
def op13_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))
