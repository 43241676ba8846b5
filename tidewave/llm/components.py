"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_store import drop, staged


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step on edges (a > b).

    Large: each node's larger neighbours are tied to its least neighbour or itself.
    Small: each node and its smaller neighbours are tied to the least of them.
    """
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    else:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        tied = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.where("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id in links (a, b).

    Every round's edges are written to the shared folder, so that lineage stays
    short; the rounds grow with the logarithm of a component's size.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = _state(edges)
    while before[0]:
        tied = staged(_star(_star(edges, small=False), small=True))
        drop(edges)
        edges, after = tied, _state(tied)
        if after == before:
            break
        before = after
    own = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(own)
