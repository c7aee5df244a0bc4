"""Connected components over edges between 64-bit keys, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import Stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    hung = both.where(F.col("v") > F.col("u")).join(least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) to (node, root), root the smallest node of the component; nodes without edges are absent.

    Loops, repeated edges and either direction are allowed. Every round is written to the shared folder.
    """
    tidy = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = Stored(tidy, "edges")
    mark = None
    while True:
        new = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not new[0] or tuple(new) == mark:
            break
        mark = tuple(new)
        step = Stored(_small_star(_large_star(now.df)), "edges")
        now.drop()
        now = step
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
