"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: connect each node's neighbours to the smallest node among them and itself.

    Large stars move the larger neighbours, small stars the smaller ones. The minimum is pre-aggregated in each
    task; the join back is a plain equi-join, so AQE can split a hot node.
    """
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): every node of an edge (a, b long) with the smallest node that it can reach.

    Rounds grow with the logarithm of the longest path; each is one table in the shared folder, the one before is
    deleted. Only a checksum of the edges comes to the driver.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sign == before or not sign[0]:
            break
        before = sign
        wide = scratch.save(star(now, True))
        then = scratch.save(star(wide, False))
        scratch.drop(now, wide)
        now = then
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
