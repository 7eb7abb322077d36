"""Connected components by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _star(links: DataFrame, large: bool) -> DataFrame:
    if large:
        near = links.union(links.select("v", "u")).toDF("u", "v")
    else:
        near = links
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    met = near.join(least, F.col("u") == F.col("_u")).where("v > u" if large else "true")
    out = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("_u", "m"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _settled(links: DataFrame) -> bool:
    """True if every link leads straight to a root: no node has two links up, and none with a link up has one down."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of the nodes of ``links`` (u, v: long)."""
    links = cut_lineage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(links):
        links = cut_lineage(_star(_star(links, True), False))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest one of its component, for links that fit in memory; roots have none."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    of = list(range(len(nodes)))

    def root(a: int) -> int:
        while of[a] != a:
            of[a] = a = of[of[a]]
        return a

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        x, y = root(a), root(b)
        of[max(x, y)] = min(x, y)
    up = np.array([root(a) for a in range(len(nodes))], dtype=np.int64)
    own = up != np.arange(len(nodes))
    return nodes[own], nodes[up[own]]


def forests(links: DataFrame, *group: str) -> DataFrame:
    """u, v: a forest of the links (u, v: long) of each group, each group in one task."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        u, v = forest(df["u"].to_numpy(), df["v"].to_numpy())
        return pd.DataFrame({"u": u, "v": v})

    return links.groupBy(*group).applyInPandas(one, "u long, v long")
