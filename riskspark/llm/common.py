"""Small helpers shared by the corpus operators."""

import shutil
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import materialise

#: A side of a join is broadcast only if it has at most so many rows of a few numbers each (about 16 MB).
BROADCAST_ROWS = 500_000
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column's text modulo ``modulus``; a null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def whole(column: str) -> Column:
    """A text column with nulls as empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay within ``limit``; otherwise Spark chooses."""
    return F.broadcast(df) if rows <= limit else df


def without(docs: DataFrame, losers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in the one-column table ``losers``; null keys stay."""
    gone = materialise(losers, "losers")
    return docs.join(sized(gone, gone.count()), key, "left_anti").select(docs.columns)


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers once a session, for sessions whose workers do not have it."""
    context = spark.sparkContext
    if not getattr(context, "_riskspark_shipped", False):
        package = Path(__file__).resolve().parents[1]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/riskspark", "zip", package.parent, package.name))
        context._riskspark_shipped = True


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last one is the intercept. Labels may be soft."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta
