"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u moves to the smallest node of u's neighbourhood; edges may repeat."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it move to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return edges.join(least, "u").select(moved).where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has all its edges (u, v), u > v, either as their v or as the u of one edge."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("below")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("below")))
    met = ends.groupBy("node").agg(F.min("below").alias("one"), F.max("below").alias("two"), F.max(F.col("below").isNull()).alias("centre"))
    return met.agg(F.max(F.expr("one < two OR one IS NOT NULL AND centre"))).first()[0] is not True


def settled(links: DataFrame) -> DataFrame:
    """Edges (u, v) with the components of ``links``, u any node with a link and v the smallest
    node of its component, which itself is no u. Edges may repeat.

    ``links`` is a written table with integer columns u and v; direction, repeats, self-links
    and nulls don't matter. Rounds go on until the edges are stars, and each round's edges are
    written to the shared folder. Minima are aggregated before the shuffle and handed back by a
    join whose other side has one row a node, so that a node with very many links is split by AQE.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while not _are_stars(edges):
        edges = written(_small_star(_large_star(edges)), "edges")
    return edges


def labels(stars: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of what ``settled`` returns, once each."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))
    return stars.select(F.inline(ends)).groupBy("node").agg(F.min("component").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node that has a link, component the smallest node reached."""
    return labels(settled(written(links, "links")))
