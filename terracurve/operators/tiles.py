"""From a tile's pixels and polygons to labelled rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curve as c
from ..functions.geo import pixel_centre
from . import raster as r
from . import scanline
from .graph import cut_lineage

#: Labelled pixels up to which they are broadcast.
FEW = 50_000


def labels_of(pixels: DataFrame, polygons: DataFrame) -> DataFrame:
    """row, col, crop: pixels that lie in polygons of one crop, once the border of each crop is taken away."""
    claims = scanline.burn(pixels, polygons)
    return r.unambiguous(r.eroded(claims, "crop"), "row", "col")


def in_labelled_blocks(pixels: DataFrame, labels: DataFrame, side: int = 256) -> DataFrame:
    """``pixels`` with block_row and block_col, of blocks that hold a label; others needn't be read further."""
    at = lambda name: F.expr(f"{name} div {side}").alias(f"block_{name}")
    return pixels.select("*", at("row"), at("col")).join(labels.select(at("row"), at("col")).distinct(), ["block_row", "block_col"], "left_semi")


def labelled_rows(
    pixels: DataFrame, polygons: DataFrame, codes: dict[str, int], origin: tuple[float, float], step: tuple[float, float],
    window: tuple[int, int] | None = None, smooth: Callable[[Column], Column] = c.smooth,
) -> DataFrame:
    """row, col, crop, code, lon, lat, curve of the pixels that one crop holds and that have a value.

    ``pixels``: row, col, red and nir (arrays by date). Labels come first and are counted: a few meet the pixels where these
    lie, and many are shuffled with them. Pixels are never broadcast, however small the planner takes their arrays for. Curves
    are smoothed whole and cut to ``window`` (first place, number) afterwards.
    """
    names = F.create_map(*(x for k, v in codes.items() for x in (F.lit(k), F.lit(v))))
    labels = cut_lineage(labels_of(pixels, polygons))
    few = labels.limit(FEW + 1).count() <= FEW
    df = pixels.join(labels.hint("broadcast" if few else "merge"), ["row", "col"])
    # Depends on both sides, so that no curve is made of a pixel without a label.
    df = df.withColumn("curve", F.when(F.col("crop").isNotNull(), F.zip_with("nir", "red", c.normalized_difference))).where(c.has_value(F.col("curve")))
    df = df.withColumn("curve", smooth(F.col("curve")))
    df = df if window is None else df.withColumn("curve", c.cut(F.col("curve"), *window))
    lon, lat = pixel_centre(F.col("col"), origin[0], step[0]), pixel_centre(F.col("row"), origin[1], step[1])
    return df.select("row", "col", "crop", F.try_element_at(names, F.col("crop")).alias("code"), lon.alias("lon"), lat.alias("lat"), "curve")
