"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    return (
        both.where("b > a").join(least, "a")
        .select(F.least("a", "low").alias("a"), "b").where("a < b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("low"))
    moved = edges.join(least, "b").where("a > low").select(F.col("low").alias("a"),
                                                           F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("low").alias("a"), "b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs; loops and repeats allowed).

    ``root`` is the smallest node of the component.  Minima are folded map-side, so a hub of
    any degree is one row per task; every round is written to the shared folder.
    """
    edges = stage(
        edges.where("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges")
    before = _mark(edges)
    while before[0]:
        edges = stage(_small_star(stage(_large_star(edges), "star")), "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
