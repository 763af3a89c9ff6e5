"""Connected components by alternating large and small stars, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.session import materialize


def _with_least(links: DataFrame) -> DataFrame:
    """Each link u -> v beside the least v of u. The sums are pre-aggregated, the join may be split when skewed."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    return links.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _with_least(both)
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from the greater node to the smaller one."""
    seen = _with_least(edges)
    return seen.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(
        seen.select("u", F.col("least").alias("v"))
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link between different nodes; root is the component's least node.

    Links may repeat, lead either way round or to the node itself; NULL ends are dropped. Every round is written to the
    shared checkpoint folder, so that a lost executor costs one round at most. Rounds grow with the logarithm of the
    longest path.
    """
    edges = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    edges = materialize(edges)
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
