"""Pixel algebra: one row a pixel, keys row and col (and tile)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a block: no window sorts more pixels than a row of a block has. Rows of a strip: no task joins more runs than a strip of a block has.
BLOCK, STRIP = 4096, 256


def eroded(mask: DataFrame, *group: str) -> DataFrame:
    """Pixels with all eight neighbours in their group's mask; what isn't in the mask, or lies outside, is background.

    Each pixel votes for the nine around it, so one aggregation does it.
    """
    near = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1))))
    votes = mask.select(*group, "row", "col").distinct().withColumn("d", near)
    votes = votes.select(*group, (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col"))
    return votes.groupBy(*group, "row", "col").agg(F.count(F.lit(1)).alias("n")).where("n = 9").drop("n")


def usable_labels(burned: DataFrame, code: str = "code", none: int = 0, several: int = 255) -> DataFrame:
    """Pixels with the code of a class: not that of pixels without a label, nor that of pixels which several classes claim."""
    return burned.where(F.col(code).isNotNull() & ~F.col(code).isin(none, several))


def coded(pixels: DataFrame, claims: DataFrame, codes: dict[str, int], none: int = 0, several: int = 255) -> DataFrame:
    """``pixels`` (row, col, ...) with code: the class that alone claims the pixel (row, col, crop), ``several`` if more than one does, ``none`` if no one does."""
    of = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    by = claims.groupBy("row", "col").agg(F.count_distinct("crop").alias("_n"), F.min("crop").alias("_crop"))
    met = pixels.join(by, ["row", "col"], "left")
    return met.withColumn("code", F.when(F.col("_n") > 1, several).otherwise(F.coalesce(F.try_element_at(of, F.col("_crop")), F.lit(none)))).drop("_n", "_crop")


def unambiguous(claims: DataFrame, *keys: str) -> DataFrame:
    """Pixels that exactly one crop claims."""
    return claims.groupBy(*keys).agg(F.count_distinct("crop").alias("n"), F.min("crop").alias("crop")).where("n = 1").drop("n")


def with_runs(mask: DataFrame) -> DataFrame:
    """row, col, block, start of the pixels of ``mask``: start is the first column of the pixel's run in its row; runs end at blocks."""
    px = mask.select("row", "col").distinct().withColumn("block", F.floor(F.col("col") / BLOCK))
    order = Window.partitionBy("row", "block").orderBy("col")
    new = F.when(F.coalesce(F.lag("col").over(order) != F.col("col") - 1, F.lit(True)), F.col("col"))
    return px.withColumn("_new", new).select("row", "col", "block", F.last("_new", ignorenulls=True).over(order).alias("start"))


def run_links(runs: DataFrame) -> DataFrame:
    """u, v: links between the runs (row, block, start, end, node) of a mask that meet along an edge of pixels.

    Of two runs that overlap in neighbouring rows one begins within the other, so each run looks for the last one
    that begins no later than it in the rows above and below; that one lies next to it if it also ends no earlier.
    """
    asks = runs.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("_to")).select((F.col("row") + F.col("_to")).alias("row"), "block", F.col("start").alias("at"), F.lit(1).alias("asks"), F.col("node").alias("u"), F.lit(None).cast("struct<node: long, end: long>").alias("has"))
    has = F.struct(F.col("node").cast("long").alias("node"), F.col("end").cast("long").alias("end"))
    holds = runs.select("row", "block", F.col("start").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("u"), has.alias("has"))
    order = Window.partitionBy("row", "block").orderBy("at", "asks")
    met = holds.unionByName(asks).withColumn("last", F.last("has", ignorenulls=True).over(order))
    beside = met.where((F.col("asks") == 1) & (F.col("last.end") >= F.col("at"))).select("u", F.col("last.node").alias("v"))
    ends = runs.where(F.col("end") % BLOCK == BLOCK - 1).select("row", (F.col("end") + 1).alias("start"), F.col("node").alias("u"))
    return beside.unionByName(ends.join(runs.where(F.col("start") % BLOCK == 0).select("row", "start", F.col("node").alias("v")), ["row", "start"]).select("u", "v"))


def sieved(mask: DataFrame, least: int) -> DataFrame:
    """row, col, comp, size of the 4-connected components of ``mask``, small ones marked by ``removed``.

    The graph has a node a run of pixels in a row, named by its first pixel, not a node a pixel. Runs are contracted within
    strips of ``STRIP`` rows of a block, whose size is bounded, and what is left between strips by star contraction, which takes
    a number of rounds that grows with the logarithm of the strips that a component spans.
    """
    from .graph import components, cut_lineage, forests

    px = cut_lineage(with_runs(mask).withColumn("node", F.expr("row * 4294967296 + start")))
    runs = px.groupBy("row", "block", "start", "node").agg(F.max("col").alias("end"), F.count(F.lit(1)).alias("n"))
    runs = cut_lineage(runs)
    links = run_links(runs).withColumn("strip", F.expr(f"u div {STRIP << 32}")).withColumn("block", F.expr(f"u % 4294967296 div {BLOCK}"))
    inner = F.expr(f"v div {STRIP << 32} = strip and v % 4294967296 div {BLOCK} = block")
    links = cut_lineage(links.withColumn("inner", inner))
    comp = components(forests(links.where("inner"), "strip", "block").union(links.where("not inner").select("u", "v"))).withColumnRenamed("node", "_n")
    comp = runs.join(comp, F.col("node") == F.col("_n"), "left").select("node", "n", F.coalesce("root", "node").alias("comp"))
    sizes = comp.groupBy("comp").agg(F.sum("n").alias("size"))
    of = comp.join(sizes, "comp").select(F.col("node").alias("_n"), "comp", "size")
    return px.join(of, F.col("node") == F.col("_n")).select("row", "col", "comp", "size", (F.col("size") < least).alias("removed"))


def mosaic(tiles: list[DataFrame], *keys: str) -> DataFrame:
    """Union of tiles; where they overlap the earlier tile's pixel stays, nodata or not."""
    ranked = reduce(DataFrame.unionByName, [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tiles)])
    order = Window.partitionBy(*keys).orderBy("_rank")
    return ranked.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_rank")


def erased(raster: DataFrame, mask: DataFrame, target: int, background: int, *keys: str) -> DataFrame:
    """Pixels of class ``target`` in ``mask`` become background; hit tells which."""
    m = mask.select(*keys).distinct().withColumn("_in", F.lit(True))
    df = raster.join(m, list(keys), "left")
    hit = F.coalesce(F.col("_in"), F.lit(False)) & (F.col("class") == target)
    return df.withColumn("hit", hit).withColumn("class", F.when(F.col("hit"), background).otherwise(F.col("class"))).drop("_in")


def erase_stats(marked: DataFrame, inside: Column, target: int, acres: float) -> DataFrame:
    """One row: acres of ``target`` before, removed and after within ``inside``, and the share removed (0 if there were none)."""
    before = F.count_if(inside & (F.col("hit") | (F.col("class") == target)))
    removed = F.count_if(inside & F.col("hit"))
    share = F.when(before > 0, 100.0 * removed / before).otherwise(0.0)
    return marked.agg((before * acres).alias("before"), (removed * acres).alias("removed"), ((before - removed) * acres).alias("after"), share.alias("removed_pct"))


def scored(raster: DataFrame, burned: DataFrame, target: int, nodata: int, acres: float, *keys: str) -> DataFrame:
    """crop, ref_pixels, ref_acres, mapped, pct_mapped, map_pct: of each crop's mapped reference pixels, those of class
    ``target``; pixels of several crops count for each. map_pct is the target's share of all mapped pixels."""
    mapped = raster.where(F.col("class") != nodata)
    total = mapped.agg((100.0 * F.count_if(F.col("class") == target) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("map_pct"))  # one row
    by = burned.join(mapped, list(keys)).groupBy("crop").agg(F.count(F.lit(1)).alias("ref_pixels"), F.count_if(F.col("class") == target).alias("mapped"))
    by = by.select("crop", "ref_pixels", (F.col("ref_pixels") * acres).alias("ref_acres"), "mapped", (100.0 * F.col("mapped") / F.col("ref_pixels")).alias("pct_mapped"))
    return by.join(F.broadcast(total), F.lit(True))
