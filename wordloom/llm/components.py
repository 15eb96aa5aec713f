"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, measured


def _with_least(e: DataFrame) -> DataFrame:
    """The edges (u, v) with m, the least of u and all its v.

    A node may hold a large share of all edges, so its edges are dealt by v to as many tasks as a shuffle has, and
    what these tasks found meets in one row each.
    """
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = e.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
    least = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", F.min("m").over(Window.partitionBy("u"))))
    return dealt.join(least, ["u", "part"]).drop("part")


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node's neighbourhood."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its lower neighbours are tied to the least of them; edges run from high u to low v."""
    return _with_least(e).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def _edges(e: DataFrame) -> DataFrame:
    """The distinct edges, written, with a state that tells whether they changed."""
    return cut(e.distinct(), rows=F.count(F.lit(1)), digest=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node that has an edge and isn't the least of its component.

    edges: columns a and b of long ids; order, repetition and self-loops don't matter, nulls are ignored.
    Each round is written to the shared folder; rounds end when the edge set no longer changes (a logarithmic number).
    An empty edge table gives an empty result, a table of :func:`cut`.
    """
    e, seen = _edges(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v")), None
    while measured(e)["rows"] and measured(e) != seen:
        seen, before = measured(e), e
        e = _edges(_small_star(_large_star(e)))
        forget(before)
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out._cut = e._cut
    return out
