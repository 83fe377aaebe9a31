"""Consolidating pairwise matches into groups: alternating large-star and
small-star rewrites of the edges, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Of each node, its larger neighbours are linked to the least among the
    node and its neighbours. The least is found by aggregation and joined back:
    a node with very many neighbours is never gathered in one place."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of each node, its smaller neighbours and itself are linked to the least."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _print_of(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("a"), F.bit_xor(h).alias("b")).first()
    return tuple(r)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """node, component: each node linked to another, directly or through others,
    with the least node of its component (by code point for strings).

    Edges with a null end or equal ends link nothing; repeated edges and either
    order count once; other columns are ignored; no edges give an empty frame.
    The rounds grow with the logarithm of the longest chain, not with the data;
    a run that isn't done after max_rounds raises. State is written between
    rounds, and only counts come to the driver.
    """
    scratch = Scratch(edges.sparkSession)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v"))
    e = scratch.keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _print_of(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        new = scratch.keep(_small_star(_large_star(e)))
        scratch.drop(e)
        e, now = new, _print_of(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
