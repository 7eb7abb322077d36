"""Overlay of polygons: the edges of two layers cut the plane into trapezoids that lie inside or outside of each.

For each key (a pair of polygons, or one polygon against itself) the heights of all
corners and crossings cut the plane into slabs in which no two edges cross. The edges
of a slab, in order, bound trapezoids; the parities of the edges of either layer so far tell whether
a trapezoid lies in it. So intersection, difference and union are filters on trapezoids, and so is repair: the
even-odd interior of a ring that crosses itself is the layer's trapezoids. Trapezoids are simple polygons, so they can be
burned, measured and clipped again.

Edges find their slabs by the ranks of their own ends, an equi-join; crossings are looked for among edges that meet in a
band of heights. Work for a key is that of its edges' slabs; a key with n long edges has about n times n of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import clipped_to_box, signed_area
from .graph import cut_lineage
from .scanline import edge_rows


def layered(shapes: DataFrame, layer: int, *keys: str) -> DataFrame:
    """keys, layer, x1, y1, x2, y2 of the edges of ``shapes`` (keys, xs, ys), those of no height left out, from the lower to the upper end."""
    e = edge_rows(shapes, *keys).where("y1 <> y2")
    up = F.col("y1") < F.col("y2")
    ends = [F.when(up, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    return e.select(*keys, F.lit(layer).alias("layer"), *ends)


def _crossings(edges: DataFrame, *keys: str) -> DataFrame:
    """keys, y: heights at which two edges of a key cross or touch."""
    extent = edges.groupBy(*keys).agg(F.min("y1").alias("_lo"), F.max("y2").alias("_hi"), F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_n"))
    e = edges.join(extent, list(keys)).withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.col("_n"))
    band = lambda y: F.least(F.floor((F.col(y) - F.col("_lo")) / F.col("_step")), F.col("_n") - 1)
    e = e.select(*keys, F.monotonically_increasing_id().alias("_id"), "x1", "y1", "x2", "y2", F.explode(F.sequence(band("y1"), band("y2"))).alias("_band"))
    a = e.select(*keys, "_band", *(F.col(c).alias(f"a{c}") for c in ("_id", "x1", "y1", "x2", "y2")))
    b = e.select(*keys, "_band", *(F.col(c).alias(f"b{c}") for c in ("_id", "x1", "y1", "x2", "y2")))
    boxes = F.expr("a_id < b_id and ay1 <= by2 and by1 <= ay2 and least(ax1, ax2) <= greatest(bx1, bx2) and least(bx1, bx2) <= greatest(ax1, ax2)")
    met = a.join(b, [*keys, "_band"]).where(boxes)
    d = F.expr("(ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1)")
    t = F.expr("(bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)") / F.nullif(d, F.lit(0.0))
    u = F.expr("(bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)") / F.nullif(d, F.lit(0.0))
    return met.where((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).select(*keys, (F.col("ay1") + t * (F.col("ay2") - F.col("ay1"))).alias("y"))


def _at(y: Column) -> Column:
    return F.when(y == F.col("y2"), F.col("x2")).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * ((y - F.col("y1")) / (F.col("y2") - F.col("y1"))))


def trapezoids(edges: DataFrame, *keys: str, winding: bool = False) -> DataFrame:
    """keys, low, high (heights), left_low, left_high, right_low, right_high (places of the sides at these), in0, in1.

    ``edges`` come from ``layered``, of layer 0 and, if there is one, 1. Trapezoids in neither layer are left out. With
    ``winding`` a place is inside if the ``turns`` of the edges to its left don't add up to 0, not if their number is odd.
    """
    edges = cut_lineage(edges)  # used five times
    ends = edges.select(*keys, F.col("y1").alias("y")).union(edges.select(*keys, "y2")).union(_crossings(edges, *keys)).distinct()
    order = Window.partitionBy(*keys).orderBy("y")
    events = cut_lineage(ends.withColumn("slab", F.row_number().over(order)).withColumn("high", F.lead("y").over(order)))
    rank = events.select(*keys, "y", "slab")
    e = edges.join(rank.withColumnsRenamed({"y": "y1", "slab": "_a"}), [*keys, "y1"]).join(rank.withColumnsRenamed({"y": "y2", "slab": "_b"}), [*keys, "y2"])
    e = e.withColumn("slab", F.explode(F.sequence("_a", F.col("_b") - 1))).join(events.withColumnRenamed("y", "low"), [*keys, "slab"])
    weight = F.col("turns") if winding else F.lit(1)
    e = e.select(*keys, "layer", weight.alias("_w"), "slab", "low", "high", _at(F.col("low")).alias("left_low"), _at(F.col("high")).alias("left_high"))
    side = Window.partitionBy(*keys, "slab").orderBy(F.col("left_low") + F.col("left_high"), "layer")
    so_far = lambda layer: F.sum(F.when(F.col("layer") == layer, F.col("_w")).otherwise(0)).over(side.rowsBetween(Window.unboundedPreceding, 0))
    inside = lambda layer: so_far(layer) != 0 if winding else so_far(layer) % 2 == 1
    to = lambda c: F.lead(c).over(side)
    e = e.withColumns({"right_low": to("left_low"), "right_high": to("left_high"), "in0": inside(0), "in1": inside(1)})
    return e.where("in0 or in1").drop("layer", "slab", "_w")


def trapezoid_area() -> Column:
    return (F.col("high") - F.col("low")) * (F.col("right_low") - F.col("left_low") + F.col("right_high") - F.col("left_high")) / 2


def trapezoid_vertices() -> tuple[Column, Column]:
    """xs and ys of a trapezoid; two corners coincide where it is a triangle."""
    return F.array("left_low", "right_low", "right_high", "left_high"), F.array("low", "low", "high", "high")


#: Edges of a cell up to which one task dissolves them in memory, pairs of edges that it compares at a time, and sides of slabs that it holds at a time.
MANY, PAIRS, SIDES = 1_000, 1 << 20, 1 << 20


def _heights(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Heights of all ends of edges, and where two of them cross or touch, in order."""
    found, step = [y1, y2], max(PAIRS // len(x1), 1)
    dx, dy = x2 - x1, y2 - y1
    for at in range(0, len(x1), step):
        part = slice(at, at + step)
        a = [v[part, None] for v in (x1, y1, dx, dy)]
        d = a[2] * dy - a[3] * dx
        ok = d != 0
        d = np.where(ok, d, 1.0)
        bx, by = x1 - a[0], y1 - a[1]
        t, u = (bx * dy - by * dx) / d, (bx * a[3] - by * a[2]) / d
        ok &= (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        found.append((a[1] + t * a[3])[ok])
    return np.unique(np.concatenate(found))


def _union(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """low, high, left_low, left_high, right_low, right_high of the places where the turns of the edges to the left don't add up to 0.

    A trapezoid reaches from one outer side to the next, and goes on for as many slabs as both sides do.
    """
    ys = _heights(x1, y1, x2, y2)
    first, end = np.searchsorted(ys, y1), np.searchsorted(ys, y2)
    active = np.cumsum(np.bincount(first, minlength=len(ys)) - np.bincount(end, minlength=len(ys)))
    block = np.cumsum(active) // SIDES
    found = []
    for s0, s1 in zip(*(np.searchsorted(block, np.unique(block), side=side) for side in ("left", "right")), strict=True):
        a, n = np.maximum(first, s0), np.maximum(np.minimum(end, s1) - np.maximum(first, s0), 0)
        e = np.repeat(np.arange(len(n)), n)
        slab = np.arange(len(e)) + np.repeat(a - np.cumsum(n) + n, n)

        def at(y: np.ndarray, e: np.ndarray) -> np.ndarray:
            return np.where(y == y2[e], x2[e], x1[e] + (x2[e] - x1[e]) * ((y - y1[e]) / (y2[e] - y1[e])))

        order = np.lexsort((at(ys[slab], e) + at(ys[np.minimum(slab + 1, len(ys) - 1)], e), slab))
        e, slab = e[order], slab[order]
        so_far = np.cumsum(turns[e])  # 0 after every slab, as rings are closed
        before = so_far - turns[e]
        left, right = np.flatnonzero((before == 0) & (so_far != 0)), np.flatnonzero((before != 0) & (so_far == 0))
        a, b, slab = e[left], e[right], slab[left]
        order = np.lexsort((slab, b, a))
        a, b, slab = a[order], b[order], slab[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (slab[1:] != slab[:-1] + 1)
        to = np.append(np.flatnonzero(new)[1:], len(a)) - 1 if len(a) else np.flatnonzero(new)
        a, b, low, high = a[new], b[new], ys[slab[new]], ys[slab[to] + 1]
        found.append(np.stack([low, high, at(low, a), at(high, a), at(low, b), at(high, b)]))
    return np.concatenate(found, axis=1)


def dissolved(shapes: DataFrame, side: float, *keys: str) -> DataFrame:
    """keys, ci, cj, and trapezoids of the union of all simple shapes (keys, xs, ys) of the same keys, cell by cell of ``side``.

    Shapes are cut by the cells they meet, so a task holds what lies in one cell, however many shapes the keys have; equal
    shapes count once. All rings are turned the same way; a place is in the union if the edges to its left go up more often than
    down. Only the union's outer sides leave a task. Cells of more than ``MANY`` edges are dealt to many tasks by their slabs.
    """
    along = lambda c, n: F.explode(F.sequence(F.floor(F.array_min(c) / side), F.floor(F.array_max(c) / side))).alias(n)
    at = [*keys, "ci", "cj"]
    df = shapes.select(*keys, "xs", "ys").distinct().select(*keys, "xs", "ys", along("xs", "ci")).select("*", along("ys", "cj"))
    df = clipped_to_box(df.repartition(*at), F.col("ci") * side, F.col("cj") * side, (F.col("ci") + 1) * side, (F.col("cj") + 1) * side).where(F.size("xs") > 2)
    e = edge_rows(df.withColumn("left", signed_area(F.col("xs"), F.col("ys")) > 0), *at, "left").where("y1 <> y2")
    up = F.col("y1") < F.col("y2")
    ends = [F.when(up, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    turns = F.when(up == F.col("left"), -1).otherwise(1)
    e = cut_lineage(e.select(*at, turns.alias("turns"), *ends))
    full = e.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MANY).drop("_n")
    full = cut_lineage(full.select(*(F.col(c).alias(f"_{c}") for c in at)))
    same = F.lit(True)
    for c in at:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    names = ["low", "high", "left_low", "left_high", "right_low", "right_high"]

    def one(cell: pa.Table) -> pa.Table:
        got = _union(*(cell.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2", "turns")))
        first = np.zeros(got.shape[1], dtype=np.int64)
        return pa.table({c: cell.column(c).take(first) for c in at} | dict(zip(names, got, strict=True)))

    types = ", ".join(f"`{c}` {e.schema[c].dataType.simpleString()}" for c in at)
    light = e.join(full, same, "left_anti").groupBy(*at).applyInArrow(one, f"{types}, {', '.join(f'{c} double' for c in names)}")
    if full.limit(1).count() == 0:
        return light
    dense = e.join(full, same, "left_semi").select(*at, F.lit(0).alias("layer"), "turns", "x1", "y1", "x2", "y2")
    return light.unionByName(trapezoids(dense, *at, winding=True).select(*at, *names))


def overlaid(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Trapezoids of two shapes (keys, xs, ys) for each of the keys; ``in0 and in1`` is their intersection, ``in0 and not in1`` their difference."""
    return trapezoids(layered(first, 0, *keys).unionByName(layered(second, 1, *keys)), *keys)


def repaired(shapes: DataFrame, *keys: str) -> DataFrame:
    """Trapezoids of the even-odd interior of each shape, whatever its rings cross; lines and points leave nothing."""
    return trapezoids(layered(shapes, 0, *keys), *keys).drop("in0", "in1")


def met_in_cells(a: DataFrame, b: DataFrame, side: float, a_key: str, b_key: str) -> DataFrame:
    """a_key, b_key of shapes whose boxes meet: an equi-join on the cells of ``side`` that the boxes lie in, each pair in one of them."""

    def dealt(shapes: DataFrame, p: str, key: str) -> DataFrame:
        box = {f"{p}{m}{c[0]}": f(c) for c in ("xs", "ys") for m, f in (("lo", F.array_min), ("hi", F.array_max))}
        df = shapes.select(F.col(key).alias(f"{p}key"), *(e.alias(n) for n, e in box.items()))
        for c in "xy":
            df = df.withColumn(f"_c{c}", F.explode(F.sequence(F.floor(F.col(f"{p}lo{c}") / side), F.floor(F.col(f"{p}hi{c}") / side))))
        return df

    met = dealt(a, "a_", a_key).join(dealt(b, "b_", b_key), ["_cx", "_cy"])
    for c in "xy":  # only in the cell that holds the lower corner of what the boxes share
        met = met.where((F.col(f"a_lo{c}") <= F.col(f"b_hi{c}")) & (F.col(f"b_lo{c}") <= F.col(f"a_hi{c}")) & (F.col(f"_c{c}") == F.floor(F.greatest(f"a_lo{c}", f"b_lo{c}") / side)))
    return met.select(F.col("a_key").alias(a_key), F.col("b_key").alias(b_key))
