"""The graph as keyed tables that grow by batches: an upsert is a write of its own, merged when read.

A batch owns its folders and overwrites them, so a replay changes nothing, and no older batch is rewritten. Nodes are
partitioned by label and edges by type. A batch is written as it comes, without a shuffle. Reading deals the rows of all batches
by ranges of their key, which serves the merge too; ``compact`` writes these ranges, each in order, as one batch.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.sources.tables import read

NODES = "node_id string, is_fraud boolean, state string, make string, model string, year int, attr_type string, attr_value string, batch_id bigint, label string"
EDGES = "src string, dst string, attr_type string, src_label string, batch_id bigint, rel_type string"
#: Properties that a newer batch replaces as a whole.
SET_BY_NEWEST = ["is_fraud", "state", "make", "model", "year"]
EDGE_KEY = ["src", "dst", "rel_type", "attr_type", "src_label"]


PARTS = (("nodes", "node_id", "label"), ("edges", "src", "rel_type"))


def upsert(nodes: DataFrame, edges: DataFrame, path: str, batch_id: int) -> None:
    """Add one batch of nodes and edges, each unique within the batch. Existing ones are met by key when read."""
    for rows, (name, _, kind) in zip((nodes, edges), PARTS):
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(kind).parquet(f"{path}/{name}/batch_id={batch_id}")


def _batches(spark: SparkSession, path: str) -> int:
    """How many batches a table has: its top folders, not its files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sum(status.getPath().getName().startswith("batch_id=") for status in found)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """One row per node: the newest batch sets its properties; of a contact value's spellings the least stands."""
    rows = read(spark, f"{path}/nodes", NODES, "the graph load")
    columns = ["node_id", "label", *SET_BY_NEWEST, "attr_type", "attr_value"]
    if _batches(spark, f"{path}/nodes") == 1:
        return rows.select(columns)
    newest = F.max_by(F.struct(*SET_BY_NEWEST), "batch_id").alias("newest")
    merged = rows.repartitionByRange("label", "node_id").groupBy("label", "node_id").agg(newest, F.min("attr_type").alias("attr_type"), F.min("attr_value").alias("attr_value"))
    return merged.select("node_id", "label", *[f"newest.{c}" for c in SET_BY_NEWEST], "attr_type", "attr_value")


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Every edge once. Nothing removes an edge: a claim that changes its vehicle keeps the link to the first."""
    rows = read(spark, f"{path}/edges", EDGES, "the graph load").select(EDGE_KEY)
    return rows if _batches(spark, f"{path}/edges") == 1 else rows.repartitionByRange("rel_type", "src").distinct()


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the merged graph as the first batch of a new store, in order within its files; swap paths once it is complete."""
    merged = [rows.sortWithinPartitions(kind, key) for rows, (_, key, kind) in zip((nodes(spark, path), edges(spark, path)), PARTS)]
    upsert(*merged, target, 0)
