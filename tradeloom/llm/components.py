"""Connected components of an edge list, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least id near the node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Is some node linked to two, or both a centre and linked to one? If not, the edges are stars."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (columns u, v, both long); component is the least id that links reach.

    A step costs two aggregations over the edges; stars shrink to depth one in a number of steps that grows
    with the logarithm of the longest path. The edge list lives in the checkpoint folder between steps; only
    the number of nodes that aren't settled comes to the driver. Empty edges give an empty result.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        now = kept(_small(_large(now)))
        if not _unfinished(now):
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
