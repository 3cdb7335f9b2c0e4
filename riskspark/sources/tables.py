"""Parquet tables: declared schemas in, whole-table overwrite out."""

from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class MissingUpstreamTable(FileNotFoundError):
    """An upstream step has not been run."""


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, upstream: str = "the producing step") -> DataFrame:
    """Scan a table; when it is absent say which step writes it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingUpstreamTable(f"{path} not found: run {upstream} first") from error


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite ``path``. A plan that still reads ``path`` is refused."""
    if any(_covers(path, source) for source in _roots(df)):
        raise ValueError(f"{path} is an input of the plan that would overwrite it")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def _roots(df: DataFrame) -> list[str]:
    """Root paths of the file tables that a plan reads: a few names, however many files there are."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found += [roots.apply(i).toString() for i in range(roots.size())]
    return found


def _covers(path: str, source: str) -> bool:
    """Whether a source lies in ``path`` or the other way round."""
    own, other = (urlparse(p).path.rstrip("/") + "/" for p in (path, source))
    return other.startswith(own) or own.startswith(other)
