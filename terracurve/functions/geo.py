"""Plane geometry on vertex arrays and boxes, all in one coordinate system."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curve import let


def edges(xs: Column, ys: Column) -> Column:
    """(x1, y1, x2, y2) of each edge, the closing one included."""
    at = F.sequence(F.lit(0), F.size(xs) - 1)
    nxt = lambda i: F.pmod(i + 1, F.size(xs))
    return F.transform(at, lambda i: F.struct(F.get(xs, i).alias("x1"), F.get(ys, i).alias("y1"), F.get(xs, nxt(i)).alias("x2"), F.get(ys, nxt(i)).alias("y2")))


def usable(xs: Column, ys: Column) -> Column:
    """Whether arrays are a polygon's: neither is null or holds a null or non-finite place, and there are three corners at least, not all on a line."""
    whole = lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    corners = (F.size(xs) == F.size(ys)) & (F.size(xs) >= 3)
    return F.coalesce(whole(xs) & whole(ys) & corners, F.lit(False)) & F.coalesce(F.when(whole(xs) & whole(ys) & corners, area(xs, ys) > 0), F.lit(False))


def in_polygon(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Even-odd rule with half-open edges: polygons that share a border share no point."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.size(F.filter(edges(xs, ys), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def in_box(x: Column, y: Column, prefix: str = "") -> Column:
    """The cheap test that goes before the exact one; on stored columns it prunes row groups."""
    return (x >= F.col(f"{prefix}xmin")) & (x <= F.col(f"{prefix}xmax")) & (y >= F.col(f"{prefix}ymin")) & (y <= F.col(f"{prefix}ymax"))


def boxes_meet(a: str, b: str, buffer: float = 0.0) -> Column:
    """Whether boxes with columns a.xmin ... and b.xmin ..., the latter grown by ``buffer``, overlap."""
    return (F.col(f"{a}xmin") < F.col(f"{b}xmax") + buffer) & (F.col(f"{a}xmax") > F.col(f"{b}xmin") - buffer) & (F.col(f"{a}ymin") < F.col(f"{b}ymax") + buffer) & (F.col(f"{a}ymax") > F.col(f"{b}ymin") - buffer)


def signed_area(xs: Column, ys: Column) -> Column:
    """Shoelace area, from the first vertex, so that a small polygon far from the origin loses no digits; above 0 for a ring that turns left."""
    x, y = F.get(xs, F.lit(0)), F.get(ys, F.lit(0))
    return F.aggregate(edges(xs, ys), F.lit(0.0), lambda s, e: s + (e["x1"] - x) * (e["y2"] - y) - (e["x2"] - x) * (e["y1"] - y)) / 2


def area(xs: Column, ys: Column) -> Column:
    return F.abs(signed_area(xs, ys))


def centroid(xs: Column, ys: Column) -> tuple[Column, Column]:
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    twice = F.aggregate(edges(xs, ys), F.lit(0.0), lambda s, e: s + cross(e))
    x = F.aggregate(edges(xs, ys), F.lit(0.0), lambda s, e: s + (e["x1"] + e["x2"]) * cross(e))
    y = F.aggregate(edges(xs, ys), F.lit(0.0), lambda s, e: s + (e["y1"] + e["y2"]) * cross(e))
    return F.try_divide(x, 3 * twice), F.try_divide(y, 3 * twice)


def clipped_area(xs: Column, ys: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of an axis-parallel rectangle, given by its vertices, within a box."""
    w = F.least(F.array_max(xs), x1) - F.greatest(F.array_min(xs), x0)
    h = F.least(F.array_max(ys), y1) - F.greatest(F.array_min(ys), y0)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def clipped_to_box(shapes: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """``shapes`` with xs and ys of the part of a polygon within a box, one side of the box after the other; none left gives empty arrays."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    none = F.array().cast("array<struct<x: double, y: double>>")
    df = shapes.withColumn("_v", F.zip_with("xs", "ys", point))
    for c, bound, over in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):

        def pieces(a: Column, b: Column) -> Column:  # called at once, while c, bound and over are these
            inside = lambda p: p[c] >= bound if over else p[c] <= bound
            t = (bound - a[c]) / F.nullif(b[c] - a[c], F.lit(0.0))
            cut = point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))
            return F.concat(F.when(inside(a), F.array(a)).otherwise(none), F.when(inside(a) != inside(b), F.array(cut)).otherwise(none))

        def clipped(v: Column) -> Column:
            after = F.concat(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
            return F.flatten(F.zip_with(v, after, pieces))

        df = df.withColumn("_v", let(F.col("_v"), clipped))  # a filter on what is left takes all four sides to where the shapes are read, each once
    return df.withColumns({"xs": F.transform("_v", lambda p: p["x"]), "ys": F.transform("_v", lambda p: p["y"])}).drop("_v")


def cell(x: Column, size: float = 0.1) -> Column:
    return F.floor(x / size)


def cell_centre(i: Column, size: float = 0.1) -> Column:
    return (i + 0.5) * size


def pixel_centre(index: Column, origin: float, step: float) -> Column:
    return F.lit(origin) + (index + 0.5) * step


def metres2_per_degree2(lat: float) -> float:
    """Area of a square degree at a latitude, on the sphere whose degree has 111,320 m; good to some 0.5 % for small areas."""
    return 111_320.0**2 * math.cos(math.radians(lat))
