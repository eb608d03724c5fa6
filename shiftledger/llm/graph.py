"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import drop_saved, saved

# Edges up to which the nodes of a step, two an edge at most, may be broadcast: Spark only knows the size of their files.
FEW_EDGES = 1 << 18


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    met = both.join(least if few else least.hint("merge"), F.col("a") == F.col("n"))
    tied = met.where("b > a").select(F.col("m").alias("a"), "b")
    return tied.where("a <> b").distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them. Here a < b holds."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m")
    met = edges.join(least if few else least.hint("merge"), F.col("b") == F.col("n")).select("m", "a")
    tied = met.where("m <> a").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return tied.union(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge (a, b), a < b; root is the least node of its component.

    Alternating large-star and small-star steps: rounds grow with the logarithm of the longest chain, no step holds
    a component, and the edges of a hub are reduced by a combining aggregation and a join that may be split. Empty
    edges give an empty result; edges of a node with itself and repeated edges change nothing.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        few = mark[0] <= FEW_EDGES
        after = saved(_small_star(_large_star(now, few), few), "edges")
        drop_saved(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return now.select(F.col("b").cast(kind).alias("node"), F.col("a").cast(kind).alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum: equal for two rounds only if nothing changed."""
    row = edges.agg(
        F.count("*"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")),
    ).first()
    return tuple(row)
