"""Connected components of a large edge table.

Alternating star contraction: each round points every node's larger
neighbours, and then its smaller ones, at the smallest node known, until the
edges are stars: no node points at two others, or points and is pointed at.
Rounds grow with the logarithm of the longest chain.
Each round's edges are a table in the shared folder, so a lost executor does
not force earlier rounds again, and no neighbourhood is ever collected: a
node's smallest neighbour is an aggregate, joined back, for nodes of many
neighbours apart (``skew``).

The loop ends only when all edges are stars; there is no cap on rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.skew import split_join
from starloom.llm.store import stored


def _least(edges: DataFrame) -> DataFrame:
    """(src, least, m, low, high, larger) of every node: the least of it and its
    neighbours, how many there are, its least and greatest smaller neighbour and
    the number of larger ones."""
    both = edges.union(edges.select("dst", "src"))
    smaller = F.when(F.col("dst") < F.col("src"), F.col("dst"))
    return both.groupBy("src").agg(
        F.least(F.min("dst"), F.col("src")).alias("least"), F.count("*").alias("m"),
        F.min(smaller).alias("low"), F.max(smaller).alias("high"), F.count_if(F.col("dst") > F.col("src")).alias("larger"),
    )


def _are_stars(least: DataFrame) -> bool:
    """Whether each node points at one centre, and no centre points on."""
    return least.where("low < high OR (low IS NOT NULL AND larger > 0)").isEmpty()


def _stars(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Large star on edges src > dst: each node's larger neighbours point at its
    least known node.  (Equal rows are left to the small star.)"""
    down = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = split_join(down, least.select("src", "least", "m"), "src", "m")
    return out.select(F.col("dst").alias("src"), F.col("least").alias("dst"))


def _small_stars(edges: DataFrame) -> DataFrame:
    """Small star on edges src > dst: a node and its smaller neighbours point
    at the least of them."""
    least = stored(edges.groupBy("src").agg(F.min("dst").alias("least"), F.count("*").alias("m")), "least")
    out = split_join(edges, least, "src", "m").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return out.where(F.col("src") != F.col("dst")).union(least.select("src", "least")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); the component
    is its smallest node.  Nulls and loops are ignored."""
    edges = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    )
    edges = stored(edges.distinct(), "edges")
    # one grouping a round serves the test and the large star
    while not _are_stars(least := stored(_least(edges), "least")):
        edges = stored(_small_stars(stored(_stars(edges, least), "edges")), "edges")
    roots = edges.select("dst").distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        roots.select("dst", "dst")
    )
