"""Merkle manifest of a data set: one tree for each source, one above their roots, a proof for every row.

Rows are placed in their tree's order by a range shuffle and by counts for each partition, so no tree, however
large, passes through one task. Level by level, lag and lead columns of fixed offsets, masked by a node's slot in
its run and by the run's length, give each node its siblings; the first child of a run hashes the parent. Upwards
only digests move. Downwards a node's window and its parent's path share one shuffle, so siblings are never
shuffled: a row's proof and its recomputed root are folded in the task that reads its run.
"""

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import sized
from riskspark.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node.
FAN = 16
#: Runs in a window while parents are built.
WINDOW_RUNS = 16
_PATH = "array<struct<before:string,after:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Manifest(NamedTuple):
    """``leaves``: id, ``tree``, ``pos``, ``size``, ``digest``, ``altered`` of every row; ``levels``: ``tree``, ``pos``,
    ``size``, ``digest`` from the leaves up, a tree's last level being its subroot; ``roots``: the same for the tree above
    the subroots, one row for each ``tree`` at first; ``root``: the root's digest, None without rows."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: list[DataFrame]
    root: str | None


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for a null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` (from zero) and ``size`` within their ``tree``, in ``order``, which must tell rows apart."""
    placed = materialise(
        rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).alias("_part")
    stretches = placed.groupBy("tree", part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(stretches.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size")), "offsets")
    return placed.withColumn("_part", part).join(sized(offsets, offsets.count()), ["tree", "_part"]).withColumn(
        "pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def siblings(nodes: DataFrame, runs: int) -> DataFrame:
    """``nodes`` with ``run``, ``slot`` and the joined digests ``before`` and ``after`` a node in its run; ``runs`` of them share a window."""
    placed = nodes.withColumn("run", F.floor(F.col("pos") / FAN)).withColumn("slot", F.pmod("pos", F.lit(FAN)))
    placed = placed.withColumn("_block", F.floor(F.col("run") / runs) if runs > 1 else F.col("run"))
    window = Window.partitionBy("tree", "run" if runs == 1 else "_block").orderBy("pos")
    length = F.least(F.lit(FAN), F.col("size") - F.col("run") * FAN)
    before = [F.when(F.col("slot") >= d, F.lag("digest", d).over(window)) for d in range(FAN - 1, 0, -1)]
    after = [F.when(F.col("slot") + d < length, F.lead("digest", d).over(window)) for d in range(1, FAN)]
    # concat_ws leaves nulls out.
    return placed.withColumns({"before": F.concat_ws("", *before), "after": F.concat_ws("", *after)}).drop("_block")


def parents(nodes: DataFrame) -> DataFrame:
    first = siblings(nodes.select("tree", "pos", "size", "digest").where("size > 1"), WINDOW_RUNS).where("slot = 0")
    return first.select("tree", F.col("run").alias("pos"), F.ceil(F.col("size") / FAN).alias("size"), digest_of(F.col("digest"), F.col("after")).alias("digest"))


def climb(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees whose lowest level is ``leaves``."""
    levels, most = [leaves.select("tree", "pos", "size", "digest")], leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        levels.append(materialise(parents(levels[-1]), "level"))
        most = -(-most // FAN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """``tree`` and ``digest`` of every tree's last node."""
    return reduce(DataFrame.unionByName, [level.where("size = 1").select("tree", "digest") for level in levels])


def build(
    docs: DataFrame, id_column: str = "doc_id", tree_column: str = "source", fields: Sequence[str] = FIELDS,
    altered: dict[str, Column] | None = None, where: Column | None = None,
) -> Manifest:
    """The manifest of ``docs``.

    A leaf hashes ``fields`` (see ``field``); a null tree is a tree of its own and comes first. Leaves ascend by id,
    null first; rows that repeat an id follow each other by leaf digest, so whole repeats are leaves of equal digest.
    Any text length is hashed whole. ``altered`` gives columns another value in the rows ``where`` holds; their leaf goes into
    ``altered`` and takes no part in the trees. Other columns are ignored. No rows give no trees and no root.
    """
    changed = digest_of(*(field((altered or {}).get(c, F.col(c))) for c in fields))
    digests = materialise(docs.select(
        F.col(id_column).alias("_id"), F.coalesce(F.concat(F.lit("1"), F.col(tree_column).cast("string")), F.lit("0")).alias("tree"),
        digest_of(*(field(F.col(c)) for c in fields)).alias("digest"),
        (F.when(where, changed) if where is not None else F.lit(None).cast("string")).alias("altered"),
        F.monotonically_increasing_id().alias("_row")), "leaves")
    leaves = materialise(numbered(digests, ("_id", "digest", "_row")).drop("_row"), "leaves")
    levels = climb(leaves)
    subroots = tops(levels).withColumnRenamed("tree", "_source").withColumn("tree", F.lit("all"))
    above = materialise(numbered(materialise(subroots, "subroots"), ("_source",)), "subroots")
    roots = [above, *climb(above)[1:]]
    last = tops(roots).first()
    return Manifest(leaves, levels, roots, last.digest if last else None)


def _steps(nodes: DataFrame, above: DataFrame | None, carried: Sequence[str]) -> DataFrame:
    """``nodes`` of trees with several nodes, with their ``path``: own siblings, then the path of the parent in ``above``."""
    own = siblings(nodes.where("size > 1"), 1)
    step = F.array(F.struct("before", "after"))
    found = own.join(above.select("tree", F.col("pos").alias("run"), F.col("path").alias("_up"), *carried), ["tree", "run"])
    return found.withColumn("path", F.concat(step, "_up")).drop("_up", "before", "after", "run", "slot")


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with ``subroot`` and its ``path``: the joined digests before and after it, from its run up to the root."""
    empty = F.array().cast(_PATH)
    path = manifest.roots[-1].where("size = 1").withColumn("path", empty)
    for level in reversed(manifest.roots[:-1]):
        path = materialise(_steps(level, path, ()), "proofs")
    if len(manifest.roots) == 1:
        path = manifest.roots[0].withColumn("path", empty)
    trees = path.select(F.col("_source").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("_top"))

    def whole(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
        alone = nodes.where("size = 1").join(trees, "tree").withColumnRenamed("_top", "path")
        return alone if above is None else alone.unionByName(_steps(nodes, above, ("subroot",)))

    found = None
    for level in reversed(manifest.levels[1:]):
        found = materialise(whole(level, found), "proofs")
    return whole(manifest.leaves, found)


def fold(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda own, step: digest_of(step["before"], own, step["after"]))


def check(manifest: Manifest, id_column: str = "doc_id") -> DataFrame:
    """One row per leaf: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (from the altered leaf where
    there is one) and ``verified``: whether the folded root is the root."""
    root = F.lit(manifest.root).cast("string")
    joined = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    rows = proofs(manifest).select(
        F.col("_id").alias(id_column), F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(joined, 256).alias("proof_sha256"),
        fold(F.col("path"), F.coalesce("altered", "digest")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def verify(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """Rows of ``check`` for ``documents``, with A-Z lower-cased in the texts whose id's crc32 ``modulus`` divides; a null id's text stays."""
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == 0, F.lit(False))
    return check(build(docs, altered={"text": F.translate(F.col("text"), _UPPER, _LOWER)}, where=tampered))


#: Twin of the query over ``documents``.
SQL = """
WITH RECURSIVE docs AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN xor(list_reduce(
   list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
   lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)
  ), 4294967295::BIGINT) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents),
heads AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree,
  coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
  || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head, text, other FROM docs),
leaves AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(other)::VARCHAR || ':' || other, '-')) AS altered FROM heads),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
known AS (SELECT *, tree || ' ' || pos AS id FROM placed),
nodes(level, tree, pos, size, digest) AS (SELECT 0, tree, pos, size, leaf FROM placed UNION ALL
  SELECT level + 1, tree, pos // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY level, tree, pos // 16, size),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
above(level, pos, size, digest) AS (SELECT 0, pos, size, digest FROM subroots UNION ALL
  SELECT level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM above WHERE size > 1 GROUP BY level, pos // 16, size),
steps AS (SELECT tree, level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM (SELECT * FROM nodes UNION ALL SELECT level, NULL, pos, size, digest FROM above) WHERE size > 1
  WINDOW w AS (PARTITION BY tree, level, pos // 16 ORDER BY pos)),
low(id, tree, level, pos, own, proof) AS (SELECT id, tree, 0, pos, altered, '' FROM known UNION ALL
  SELECT l.id, l.tree, l.level + 1, l.pos // 16, sha256(b || own || a), proof || b || a FROM low l JOIN steps s ON s.tree = l.tree AND s.level = l.level AND s.pos = l.pos),
met AS (SELECT id, arg_max(own, level) AS own, arg_max(proof, level) AS proof, any_value(tree) AS tree FROM low GROUP BY id),
high(id, level, pos, own, proof) AS (SELECT id, 0, pos, own, proof FROM met JOIN subroots USING (tree) UNION ALL
  SELECT h.id, h.level + 1, h.pos // 16, sha256(b || own || a), proof || b || a FROM high h JOIN steps s ON s.tree IS NULL AND s.level = h.level AND s.pos = h.pos),
last AS (SELECT id, arg_max(own, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM high GROUP BY id)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, proof_sha256, folded_root, folded_root = r.digest AS verified
FROM known JOIN last USING (id) JOIN subroots s USING (tree) CROSS JOIN (SELECT digest FROM above WHERE size = 1) r
"""
