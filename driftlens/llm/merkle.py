"""Merkle manifest of a dataset by checkpoint and recompute.

Every source is a tree over its documents in order of id, and the trees' roots are the leaves of one tree over all sources. A node is the digest of
ARITY nodes one level below. Of a tree only every STEP-th level is stored, beginning with the leaves; its nodes lie in groups of ARITY^STEP, each
below one stored node of the next stored level (an aligned subtree). Going up, a group is folded to its one node and the levels between are dropped.
Going down, proofs come from the groups again: each regenerates its levels in memory, gives every member its siblings there, and passes
them on with what its own node was given from above.

No group is larger than ARITY^STEP members, whatever the sources' sizes are; places in order come from range partitions, not from a sort in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.llm.common import text_batches, written
from driftlens.session import materialize

ARITY = 3
STEP = 4

# A row of partition p has the number p * 2^33 + its place there (so counts `monotonically_increasing_id`).
PLACE_BITS = 33


def _part(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column | None = None) -> Column:
    """The digest of a document's fields, each with its length in bytes; NULL is a dash."""
    fields = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string") if text is None else text
    return F.sha2(F.concat(*[_part(f) for f in fields], _part(text)).cast("binary"), 256)


def in_order(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`position` (from 0) of every row in its tree by `order`, and `total`, the tree's number of rows.

    `df` must be stored and `order` leave no ties (equal rows are told apart by a number of their own). Rows are range-partitioned and
    sorted in their partitions; what precedes a partition is a sum over at most one number per tree and partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    runs = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(tree).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        F.col(tree).alias("_tree"),
        F.col("_part").alias("_run"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(W.partitionBy(tree)).alias("total"),
    )
    met = placed.join(runs, (F.col(tree) == F.col("_tree")) & (F.col("_part") == F.col("_run")))
    return met.withColumn("position", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_tree", "_run", "_shift")


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], total: int, step: int) -> list[list[str]]:
    """The levels from a group's members up to its node; the only group of a tree (of `total` nodes) ends as soon as one node is left."""
    levels = [nodes]
    while len(levels) <= step and (len(levels[-1]) > 1 or total > ARITY**step):
        last = levels[-1]
        levels.append([_hash(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return levels


def grouped(df: DataFrame, tree: str, members: list[str], step: int, name: str) -> DataFrame:
    """Aligned subtrees: (tree, parent, total, members), stored. `members` always has position and digest."""
    groups = df.groupBy(tree, F.expr(f"position div {ARITY**step}").alias("parent"), "total")
    return written(groups.agg(F.array_sort(F.collect_list(F.struct("position", *members))).alias("members")), name)


def fold_groups(groups: DataFrame, tree: str, step: int) -> DataFrame:
    """One stored level up: (tree, position, total, digest, done); a done one is its tree's root."""

    size = ARITY**step

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, nodes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = [_levels(n, t, step)[-1][0] for n, t in zip(nodes, totals)]
            above = pa.array([-(-t // size) for t in totals], pa.int64())
            done = pa.array([t <= size for t in totals], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), above, pa.array(found, pa.string()), done], [tree, "position", "total", "digest", "done"]
            )

    rows = groups.select(tree, "parent", "total", F.col("members.digest").alias("nodes"))
    return rows.mapInArrow(fold, f"{tree} string, position long, total long, digest string, done boolean")


def build(leaves: DataFrame, tree: str, members: list[str], step: int = STEP) -> tuple[list[DataFrame], DataFrame]:
    """(the stored levels as groups, lowest first; (tree, digest, level) of every tree's root, and the stored level it lies above)."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    levels, roots = [], []
    nodes = leaves
    while True:
        levels.append(grouped(nodes, tree, members if not levels else ["digest"], step, f"merkle-level-{len(levels)}"))
        up = materialize(fold_groups(levels[-1], tree, step))
        roots.append(up.where("done").select(tree, "digest", F.lit(len(levels) - 1).alias("level")))
        nodes, most = up.where("NOT done"), -(-most // ARITY**step)
        if most <= 1:
            return levels, reduce(DataFrame.unionAll, roots)


def _siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(siblings to the left, to the right) of a member, level by level."""
    out = []
    for nodes in levels[:-1]:
        start = at - at % ARITY
        out.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + ARITY])))
        at //= ARITY
    return out


def _climb(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


_PROOF = {
    "doc_id": (pa.int64(), "long"),
    **{n: (pa.string(), "string") for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")},
    "verified": (pa.bool_(), "boolean"),
}
_PATH = "array<struct<left:string,right:string>>"


def paths_down(groups: DataFrame, above: DataFrame, tree: str, payload: str, step: int = STEP) -> DataFrame:
    """(tree, position, `payload` of the members, root, path): siblings of every member up to the top of `above` (tree, position, root, path)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                members = batch.column(2)[row].values
                levels = _levels(members.field("digest").to_pylist(), batch.column(1)[row].as_py(), step)
                upper = [(p["left"], p["right"]) for p in batch.column(4)[row].as_py()]
                paths = [[{"left": a, "right": b} for a, b in [*_siblings(levels, k), *upper]] for k in range(len(members))]
                n = len(members)
                columns = [batch.column(k).slice(row, 1).take(pa.array([0] * n, pa.int32())) for k in (0, 3)]
                kept = [members.field(c) for c in ("position", payload)]
                path_type = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [columns[0], *kept, columns[1], pa.array(paths, path_type)], [tree, "position", payload, "root", "path"]
                )

    rows = _with_above(groups, above, tree).select(tree, "total", "members", "root", "path")
    return rows.mapInArrow(extract, f"{tree} string, position long, {payload} string, root string, path {_PATH}")


def _with_above(groups: DataFrame, above: DataFrame, tree: str) -> DataFrame:
    above = above.select(F.col(tree).alias("_tree"), F.col("position").alias("_position"), "root", "path")
    return groups.join(above, (F.col(tree) == F.col("_tree")) & (F.col("parent") == F.col("_position"))).drop("_tree", "_position")


def descend(levels: list[DataFrame], roots: DataFrame, tops: DataFrame, tree: str, step: int = STEP) -> DataFrame:
    """The paths above the lowest groups, from those of the trees' roots, `tops` (tree, root, path)."""
    held = tops.join(roots.select(F.col(tree).alias("_tree"), "level"), F.col(tree) == F.col("_tree")).drop("_tree")
    held = materialize(held.withColumn("position", F.lit(0).cast("long")).select(tree, "position", "root", "path", "level"))
    above = held.where(F.col("level") == len(levels) - 1).drop("level")
    for level in range(len(levels) - 1, 0, -1):
        down = paths_down(levels[level], above, tree, "digest", step).select(tree, "position", "root", "path")
        above = materialize(down).unionAll(held.where(F.col("level") == level - 1).drop("level"))
    return above


def manifest(docs: DataFrame, tampered: Column | None = None, step: int = STEP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per document, in no order.

    `tampered` is the text that is checked against the manifest (none: the text itself); all but folded_root and verified are of the texts as
    they are. A NULL source is a source of its own, before all others; within one, NULL ids come first, and rows with the same id follow by
    leaf (equal rows in any order; each is a leaf). NULL fields count as a dash. A document alone in its source is its subroot, a source alone is the root,
    and a document alone in all has an empty proof. Other columns are not read. An empty table gives an empty table.
    """
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", "source", "lang", "n_chars", F.col("text").cast("string").alias("text"))
    source = F.col("source").cast("string")
    tree = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    shown = leaf(F.col("text") if tampered is None else tampered)
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long"), leaf().alias("digest"), shown.alias("shown"))
    leaves = leaves.withColumn("shown", F.when(F.col("shown") != F.col("digest"), F.col("shown")))
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    placed = in_order(leaves, "tree", ["doc_id", "digest", "row"]).drop("row")
    levels, roots = build(placed, "tree", ["digest", "doc_id", "shown"], step)
    roots = materialize(roots)

    # The tree over the sources.
    sources = in_order(roots.select(F.lit("all").alias("all"), "tree", "digest"), "all", ["tree"])
    upper_levels, upper_root = build(sources, "all", ["digest", "tree"], step)
    empty = F.array().cast(_PATH)
    top = upper_root.select("all", F.col("digest").alias("root"), empty.alias("path"))
    above = descend(upper_levels, upper_root, top, "all", step)
    tops = paths_down(upper_levels[0], above, "all", "tree", step).select("tree", "root", "path")

    above = descend(levels, roots, tops, "tree", step)
    subroots = roots.select(F.col("tree").alias("_tree"), F.col("digest").alias("subroot"))
    met = _with_above(levels[0], above, "tree").join(subroots, F.col("tree") == F.col("_tree"))

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Proof and fold of every member of every group; one climb above the group for all members that arrive with the same node."""
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _PROOF}
            for row in batch.to_pylist():
                levels = _levels([m["digest"] for m in row["members"]], row["total"], step)
                upper = [(p["left"], p["right"]) for p in row["path"]]
                above = "".join(a + b for a, b in upper)
                arrived: dict[str, str] = {}
                for k, member in enumerate(row["members"]):
                    inside = _siblings(levels, k)
                    proof = hashlib.sha256(("".join(a + b for a, b in inside) + above).encode()).hexdigest()
                    node = _climb(member["shown"] or member["digest"], inside)
                    if node not in arrived:
                        arrived[node] = _climb(node, upper)
                    values = (member["doc_id"], member["digest"], row["subroot"], row["root"], proof, arrived[node], arrived[node] == row["root"])
                    for name, value in zip(_PROOF, values):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({n: pa.array(out[n], t) for n, (t, _) in _PROOF.items()})

    return met.select("total", "members", "root", "path", "subroot").mapInArrow(proofs, ", ".join(f"{n} {t}" for n, (_, t) in _PROOF.items()))


def without_line_breaks() -> Column:
    """The text without its line breaks where the id's crc32 is even, else as it is."""
    text = F.col("text").cast("string")
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)
