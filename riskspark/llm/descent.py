"""Near-duplicate vectors by nearest-neighbour descent.

Identical vectors of a label collapse to one point first. Random projections sort the points of each label several
times; neighbours in those orders start a neighbour graph. Each round joins neighbours with their neighbours and keeps
the best of each list, looking only along edges that are new; lists whose weakest member still passes the threshold are
saturated and grow. When lists settle, edges of at least ``COARSE`` (twice the threshold's angle) give coarse
components; inside each, all pairs are compared in blocks of bounded size. So a dense cluster's links are counted
exactly, however many there are, without being written out: a block returns counts and a spanning forest of its links.

The number of signs follows the largest label, so that few points share them, and the number of projections follows from
it: a pair at the threshold shares all signs of one projection with a known chance, and must do so in one of them.

A bounded set of query vectors is then compared with all points by brute force. Recall counts by query vector, and apart for
vectors with few links, so a dense cluster cannot hide lost pairs. If it is below the goal, the search is repeated with further
projections and its edges are added; if it stays below what is allowed, the search fails and says what it measured.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.components import connected_components
from riskspark.session import materialise

THRESHOLD = 0.98
COARSE = 2 * THRESHOLD**2 - 1
#: Points that share all signs of a projection, about; neighbours in its order that are taken; the chance that a pair at the threshold is met.
SHARED, NEXT, MET = 4, 4, 0.99
#: Members of a list, of a grown list, neighbours that are followed, rounds, and the share of new members that ends them.
LIST, GROWN, FOLLOWED, ROUNDS, SETTLED = 10, 40, 4, 4, 0.002
BLOCK = 1024
#: Query vectors of the audit, its goal, what is allowed in the end, and how often the search may run.
AUDIT, RECALL, ALLOWED, TURNS = 1000, 0.98, 0.9, 5
#: Vectors with at most so many links are also audited apart.
FEW = 10


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Signs and projections for a label of ``rows`` points."""
    bits = min(60, max(2, math.ceil(math.log2(max(rows, 1) / SHARED))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(1 - MET) / math.log(1 - same))) if same < 1 else 2


def usable(vector: str, label: str) -> Column:
    """Whether a vector can link: it has a label, finite components without nulls, and one that is not zero."""
    column = F.col(vector)
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & F.col(label).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors as rows, in double precision; shorter ones are filled with zeros, which changes no product."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def projections(points: DataFrame, trees: int, bits: int, seed: int) -> DataFrame:
    """Each point once per tree, with the signs of ``bits`` random directions and one projection to sort by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = matrix(batch.column(2))
            width = vectors.shape[1]
            if width not in directions:
                directions[width] = np.random.default_rng([seed, width]).standard_normal((width, trees * (bits + 1)))
            seen = (vectors @ directions[width]).reshape(len(vectors), trees, bits + 1)
            signs = (seen[:, :, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
            for tree in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(vectors), tree, np.int32)), pa.array(signs[:, tree]),
                     pa.array(seen[:, tree, bits]), batch.column(1), batch.column(2)],
                    names=["grp", "tree", "sign", "at", "rep", "vector"])

    kind = points.schema["vector"].dataType.simpleString()
    return points.select("grp", "rep", "vector").mapInArrow(run, f"grp string, tree int, sign long, at double, rep long, vector {kind}")


def start(points: DataFrame, trees: int, bits: int, seed: int) -> DataFrame:
    """``u``, ``v``, ``sim`` of points that follow each other in a projection's order.

    The order is by range partitions, so one label or one dense cluster spreads over many tasks; pairs across a
    partition's edge are left to the descent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for batch in batches:
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            vectors = matrix(batch.column(5))
            groups = np.array(batch.column(0).to_pylist(), object)
            trees_, ids = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            u, v, sim = [], [], []
            for step in range(1, NEXT + 1):
                same = np.flatnonzero((groups[step:] == groups[:-step]) & (trees_[step:] == trees_[:-step]))
                u.append(ids[same])
                v.append(ids[same + step])
                sim.append(np.einsum("ij,ij->i", vectors[same], vectors[same + step]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v, sim)], names=["u", "v", "sim"])
            last = batch.slice(max(0, batch.num_rows - NEXT))

    order = ["grp", "tree", "sign", "at", "rep"]
    ordered = projections(points, trees, bits, seed).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "u long, v long, sim double").distinct()


def similarities(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """``pairs`` (``u``, ``v``) with their cosine."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = np.einsum("ij,ij->i", matrix(batch.column(2)), matrix(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["u", "v", "sim"])

    own = points.select("rep", "vector")
    left = own.withColumnsRenamed({"rep": "u", "vector": "a"})
    right = own.withColumnsRenamed({"rep": "v", "vector": "b"})
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long, sim double")


def lists(edges: DataFrame, threshold: float) -> DataFrame:
    """The best of each point's neighbours from undirected ``edges``: ``LIST`` of them, or all that pass the threshold up to ``GROWN``."""
    both = edges.select("u", "v", "sim", "fresh").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "fresh"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    kept = ranked.where((F.col("rank") <= LIST) | ((F.col("sim") >= threshold) & (F.col("rank") <= GROWN)))
    full = Window.partitionBy("u")
    return kept.withColumn("saturated", F.min("sim").over(full) >= threshold)


def descend(points: DataFrame, edges: DataFrame, threshold: float, rounds: int) -> DataFrame:
    """Edges (``u`` < ``v``, ``sim``) of the refined graph."""
    graph = materialise(lists(_ordered(edges).withColumn("fresh", F.lit(True)), threshold), "graph")
    total = graph.count()
    for _ in range(rounds):
        followed = graph.where((F.col("rank") <= FOLLOWED) | (F.col("saturated") & (F.col("rank") <= 2 * FOLLOWED)))
        first = followed.select("u", F.col("v").alias("by"), F.col("fresh").alias("f1"))
        second = followed.select(F.col("u").alias("by"), "v", F.col("fresh").alias("f2"))
        known = graph.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim").distinct()
        # An edge's reverse may be missing from the other's list, so both directions of a step are followed.
        steps = first.join(second, "by").where("u <> v AND (f1 OR f2)").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        fresh = similarities(steps.join(known, ["u", "v"], "left_anti"), points).withColumn("fresh", F.lit(True))
        graph = materialise(lists(known.withColumn("fresh", F.lit(False)).unionByName(fresh), threshold), "graph")
        if graph.where("fresh").count() <= SETTLED * total:
            break
    return _ordered(graph)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("sim").alias("sim"))


def _block_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.column(0).to_pylist()
            members = batch.column(1)
            bounds = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))])
            flat = members.flatten()
            ids, copies, side = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            out: list[tuple[list, list, list]] = []
            for row, alone in enumerate(same):
                own = slice(bounds[row], bounds[row + 1])
                vectors, ids_, copies_, side_ = matrix(flat.field(3).slice(bounds[row], bounds[row + 1] - bounds[row])), ids[own], copies[own], side[own]
                linked = vectors @ vectors.T >= threshold
                np.fill_diagonal(linked, False)
                if not alone:
                    linked &= side_[:, None] != side_[None, :]
                counts = linked @ copies_
                parent = np.full(len(ids_), -1)
                for seed in range(len(ids_)):
                    if parent[seed] >= 0 or not counts[seed]:
                        continue
                    parent[seed], open_ = seed, [seed]
                    while open_:
                        node = open_.pop()
                        new = np.flatnonzero(linked[node] & (parent < 0))
                        parent[new] = node
                        open_ += new.tolist()
                hit = np.flatnonzero(counts)
                out.append((ids_[hit].tolist(), counts[hit].tolist(), ids_[parent[hit]].tolist()))
            columns = [[x for o in out for x in o[i]] for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "linked", "parent"])

    return run


def block_links(points: DataFrame, coarse: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``rep``, ``linked`` (vectors linked within a pair of blocks), ``parent`` (a linked point, or itself).

    ``coarse``: ``rep``, ``component``. Components are cut into blocks by a hash of the id; each pair of blocks is a group.
    """
    sizes = coarse.groupBy("component").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block)).drop("count")
    member = points.join(coarse, "rep").join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    spread = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = spread.groupBy("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("rep", "copies", F.col("own").alias("side"), "vector")).alias("members"))
    return grouped.select((F.col("i") == F.col("j")).alias("alone"), "members").mapInArrow(_block_links(threshold), "rep long, linked long, parent long")


def audit(points: DataFrame, counted: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Recall over at most about ``queries`` points: the mean share of a point's true links that ``counted`` (``rep``, ``linked``)
    has found, over all points with links or over those with few, whichever is less; 1 if no point has any."""
    share = min(1.0, queries / max(1, points.count()))
    chosen = points.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)
    rows = chosen.select("grp", "rep", "vector").collect()  # bounded by the number of queries
    if not rows:
        return 1.0
    vectors = matrix(pa.array([r["vector"] for r in rows]))
    groups, ids = np.array([r["grp"] for r in rows], object), np.array([r["rep"] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            own, other = matrix(batch.column(3)), np.array(batch.column(0).to_pylist(), object)
            reps, copies = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for group in set(other):
                q, p = np.flatnonzero(groups == group), np.flatnonzero(other == group)
                width = min(vectors.shape[1], own.shape[1])
                linked = vectors[q][:, :width] @ own[p][:, :width].T >= threshold
                total[q] += (linked & (ids[q][:, None] != reps[p][None, :])) @ copies[p]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["rep", "links"])

    truth = points.select("grp", "rep", "copies", "vector").mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    share_found = F.least(F.coalesce("linked", F.lit(0)) / F.col("links"), F.lit(1.0))
    row = truth.where("links > 0").join(counted, "rep", "left").agg(
        F.avg(share_found).alias("all"), F.avg(F.when(F.col("links") <= FEW, share_found)).alias("few")).first()
    return min(1.0 if x is None else x for x in row)


def near_vectors(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = THRESHOLD,
    trees: int | None = None, rounds: int = ROUNDS, block: int = BLOCK, queries: int = AUDIT,
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``, ``audited_recall`` (one value, as measured at the end).

    Only rows with equal labels (and as many components) are compared. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null label or id, link with nothing and are kept. Identical vectors link with
    each other and share all else; rows that repeat an id count as vectors of their own. Other columns are ignored. No
    rows give no rows.
    """
    coarse_threshold = 2 * threshold**2 - 1
    named = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), F.col(label_column).alias("label"))
    able = named.where(usable("vector", "label") & F.col("id").isNotNull()).withColumn("grp", F.concat_ws(":", F.size("vector").cast("string"), F.col("label").cast("string")))
    points = materialise(able.groupBy("grp", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "points")
    largest = points.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    bits, needed = plan(largest, threshold)
    edges, recall = None, 0.0
    for turn in range(TURNS):
        more = descend(points, start(points, trees or needed * (turn + 1), bits, 17 + turn), threshold, rounds)
        edges = materialise(more if edges is None else _ordered(edges.unionByName(more)), "edges")
        near = connected_components(edges.where(F.col("sim") >= coarse_threshold).select(F.col("u").alias("a"), F.col("v").alias("b")))
        found = materialise(block_links(points, near.withColumnRenamed("node", "rep"), threshold, block), "links")
        counted = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
        recall = audit(points, counted, threshold, queries)
        if recall >= RECALL:
            break
    if recall < ALLOWED:
        raise RuntimeError(f"the search found {recall:.3f} of the links of {queries} query vectors; {ALLOWED} are required")
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("parent").alias("b"))).withColumnRenamed("node", "rep")
    classes = points.join(counted, "rep", "left").join(components, "rep", "left").select(
        "grp", "vector", F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.coalesce("component", "rep")).toDF("grp", "vector", "links", "component")
    apart = named.where(~(usable("vector", "label") & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = able.join(classes, ["grp", "vector"]).select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    return joined.unionByName(apart).select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("audited_recall"))
