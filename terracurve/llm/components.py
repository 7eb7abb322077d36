"""Connected components of a graph that is larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half of a round: links each node's neighbours (the larger ones, or
    itself and the smaller ones) to the smallest of them and itself."""
    if large:
        near = edges.union(edges.select("v", "u")).toDF("u", "v")
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written, so that both sides of the join are plain exchanges, whose hot keys the adaptive planner splits.
    least = written(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "least")
    met = near.join(least, F.col("u") == F.col("_u"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _done(links: DataFrame) -> bool:
    """True if every link leads straight to a root: no node has two links up, and none that others lead to has one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of ``edges`` (u, v: long).

    Alternates large-star and small-star until every link leads to a root; every
    round is written, so lineage stays short. Loops and repeated links are
    allowed; an empty table gives an empty one.
    """
    links = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _done(links):
        links = written(_star(_star(links, True), False), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
