"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.session import cut_lineage, replace_step


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a vertex moves to the least vertex near it."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its lesser neighbours all move to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """All are stars: each ``a`` has one ``b``, and no ``b`` is an ``a``. Edges are distinct. One small shuffle, where another round to compare with has six."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg((F.sum("up") + F.max("top")).alias("n")).filter("n > 1").count() == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """(vertex, component): the component is the least vertex of it.

    Hot vertices are no trouble: minima combine on the map side, and in the joins
    the other side has one row per vertex, so AQE can split the hot one. All joins are
    by shuffle: both sides grow with the input, and a broadcast in each round goes through the driver.
    """
    pairs = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter("a <> b").distinct()
    lone = edges.select(F.col(src).alias("v")).union(edges.select(F.col(dst))).distinct()
    work = cut_lineage(pairs)
    for _ in range(max_rounds):
        if _settled(work):
            break
        work = replace_step(work, _small_star(_large_star(work)))
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    named = work.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return lone.join(named.hint("merge"), "v", "left").select(F.col("v").alias("vertex"), F.coalesce("component", "v").alias("component"))
