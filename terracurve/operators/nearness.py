"""What lies within a distance of polygons: cells and points meet edges in the cells around them, never each other's whole tables.

A lattice as wide as the distance, or wider, is laid over the plane. An edge is dealt to the cells it passes and the eight around
each; what is within the distance of it lies in one of these. Only there comes the exact test.
What a polygon holds far from its edges comes from its spans on the lattice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage
from .scanline import border, edge_rows, spans

_EDGE = ("x1", "y1", "x2", "y2")


def _scaled(shapes: DataFrame, side: float, *keys: str) -> DataFrame:
    return shapes.select(*keys, F.transform("xs", lambda x: x / side).alias("xs"), F.transform("ys", lambda y: y / side).alias("ys"))


def _dealt(shapes: DataFrame, side: float, key: str) -> DataFrame:
    """key, x1, y1, x2, y2 (in cells), ci, cj: each edge in the cells it passes and those around them, once each."""
    near = lambda name, lo, hi: F.explode(F.sequence(F.expr(lo), F.expr(hi))).alias(name)
    e = border(_scaled(shapes, side, key), key).select(key, *_EDGE, "first", "last", near("cj", "row - 1", "row + 1"))
    return e.select(key, *_EDGE, "cj", near("ci", "first - 1", "last + 1")).distinct()


def to_segment(x: Column, y: Column) -> Column:
    """Squared distance of a point from the segment x1, y1, x2, y2."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.least(((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / (dx * dx + dy * dy), F.lit(1.0)), F.lit(0.0))
    a, b = x - F.col("x1") - t * dx, y - F.col("y1") - t * dy
    return a * a + b * b


def segment_to_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Squared distance of the segment x1, y1, x2, y2 from a closed box; 0 if they meet."""
    ax, ay, bx, by = map(F.col, _EDGE)
    cross = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    corners = [(x0, y0), (x0, y1), (x1, y0), (x1, y1)]
    sides = [cross(*c) for c in corners]
    apart = (F.greatest(ax, bx) < x0) | (F.least(ax, bx) > x1) | (F.greatest(ay, by) < y0) | (F.least(ay, by) > y1) | (F.least(*sides) > 0) | (F.greatest(*sides) < 0)
    gap = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
    ends = [gap(x, x0, x1) * gap(x, x0, x1) + gap(y, y0, y1) * gap(y, y0, y1) for x, y in ((ax, ay), (bx, by))]
    return F.when(apart, F.least(*ends, *(to_segment(*c) for c in corners))).otherwise(0.0)


def cells_near(cells: DataFrame, shapes: DataFrame, side: float, distance: float, key: str = "id") -> DataFrame:
    """i, j of the cells (i, j: squares of ``side``) no farther than ``distance`` from a shape; ``distance`` is at most ``side``."""
    if distance > side:
        raise ValueError("cells must be as wide as the distance")
    i, j, reach = F.col("ci").cast("double"), F.col("cj").cast("double"), distance / side
    ij = cells.select(F.col("i").alias("ci"), F.col("j").alias("cj")).distinct()
    met = ij.join(_dealt(shapes, side, key), ["ci", "cj"]).where(segment_to_box(i, j, i + 1, j + 1) <= reach * reach)
    held = spans(_scaled(shapes, side, key), key).select(F.col("row").alias("cj"), F.explode(F.sequence("first", "last")).alias("ci"))
    return met.select(F.col("ci").alias("i"), F.col("cj").alias("j")).union(ij.join(held, ["ci", "cj"]).select("ci", "cj")).distinct()


#: Parts that the keys of equal shapes are dealt into.
PARTS = 256


def points_near(points: DataFrame, shapes: DataFrame, distance: float, id_col: str, x: str, y: str, key: str = "id") -> DataFrame:
    """id_col, key of points in a shape or no farther than ``distance`` from it, each pair once.

    Places and forms meet, each once; points then get the keys of the forms near their place, as lists that are unfolded last. So
    no pair of a point and a shape is shuffled or held, but for points that are given at several places.
    """
    p = points.select(F.col(id_col).alias("_p"), (F.col(x) / distance).alias("_x"), (F.col(y) / distance).alias("_y")).where("_x is not null and _y is not null")
    px, py = F.col("_x"), F.col("_y")
    keyed = shapes.select(key, F.struct("xs", "ys").alias("_ring")).groupBy(key).agg(F.sort_array(F.collect_list("_ring")).alias("_rings"))
    keyed = cut_lineage(keyed.select(key, F.sha2(F.to_json("_rings"), 256).alias("_f"), "_rings"))
    forms = keyed.groupBy("_f").agg(F.first("_rings").alias("_rings"))
    rings = forms.select("_f", F.inline("_rings"))
    at = p.select("_x", "_y").distinct().withColumn("ci", F.floor("_x")).withColumn("cj", F.floor("_y"))
    met = at.join(_dealt(rings, distance, "_f"), ["ci", "cj"]).where(to_segment(px, py) <= 1.0).select("_x", "_y", "_f")
    # Ray through the point: the cells of a form's rows, so that no place meets a form that is elsewhere.
    rows = edge_rows(_scaled(rings, distance, "_f"), "_f").where("y1 <> y2")
    rows = rows.withColumn("cj", F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))))
    bound = lambda f, c: F.floor(f(F.flatten(F.transform("_rings", lambda r: r[c]))) / distance)
    box = forms.select("_f", *(bound(f, c).alias(n) for n, f, c in (("_i0", F.array_min, "xs"), ("_i1", F.array_max, "xs"), ("_j0", F.array_min, "ys"), ("_j1", F.array_max, "ys"))))
    box = box.withColumn("ci", F.explode(F.sequence("_i0", "_i1"))).withColumn("cj", F.explode(F.sequence("_j0", "_j1")))
    asks = at.join(box.select("_f", "ci", "cj"), ["ci", "cj"]).select("_x", "_y", "_f", "cj")
    ray = ((F.col("y1") > py) != (F.col("y2") > py)) & (px < (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    held = asks.join(rows, ["_f", "cj"]).where(ray).groupBy("_x", "_y", "_f").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("_x", "_y", "_f")
    lists = keyed.groupBy("_f", F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("_part")).agg(F.collect_list(F.struct(key)).alias("_keys"))
    near = cut_lineage(met.union(held).distinct().join(lists, "_f").select("_x", "_y", "_keys"))
    places = p.groupBy("_p").agg(F.min(F.struct("_x", "_y")).alias("_a"), F.max(F.struct("_x", "_y")).alias("_b"))
    several = places.where("_a <> _b").select(F.col("_p").alias("_q"))
    unfolded = lambda df: df.join(near.hint("merge"), ["_x", "_y"]).select("_p", F.inline("_keys"))
    once = unfolded(places.where("_a = _b").select("_p", "_a.*"))
    more = unfolded(p.join(several, F.col("_p").eqNullSafe(F.col("_q")), "left_semi")).distinct()
    return once.union(more).withColumnRenamed("_p", id_col)
