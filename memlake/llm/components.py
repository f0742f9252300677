"""Connected components by alternating large and small stars, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): neighbours are pointed to the least of each node's neighbourhood.

    The least neighbour is a combinable aggregate, and a hub's edges are only joined with it,
    so that Spark can split a hub that holds most edges.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v longs): root is the least node of its component.

    Loops, repeated edges and nulls don't matter. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    edges, path = materialise(edges.where("u is not null and v is not null and u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        new, at = materialise(_stars(_stars(edges, True), False), "edges")
        release(spark, path)
        edges, path = new, at
    star = edges.groupBy("u").agg(F.min("v").alias("root"))
    return star.select(F.col("u").alias("node"), "root").unionByName(star.select(F.col("root").alias("node"), "root").distinct())
