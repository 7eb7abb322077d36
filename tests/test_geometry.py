"""Projection, scanlines, runs, overlay and nearness against plain Python."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracurve.functions import geo
from terracurve.functions import projection as pr
from terracurve.operators import arrangement as ar
from terracurve.operators import graph, nearness, raster, scanline
from terracurve.plans import catalog
from terracurve.sources.adapters import stars
from tests.compare import DATA, duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.01"
SHAPES = "id long, crop string, xs array<double>, ys array<double>"


@pytest.mark.parametrize("name", ["utm_roundtrip", "projected_acres", "tile_bounds_lonlat", "scanline_burn", "pixel_touch_polygons", "clip_polygons", "exact_cell_acres", "repaired_polygons", "buffered_exclusion", "points_near_areas", "sieve_components", "dissolved_acres", "usable_polygons", "usable_label_pixels"])
def test_sql(spark, name):
    got = spark_rows(catalog.QUERIES[name](spark, SF))
    assert got[1] and got == duck_rows(duck(SF).sql(catalog.SQL[name]))


def utm(spark, rows):
    df = spark.createDataFrame(rows, "lon double, lat double")
    e, n = pr.to_utm(F.col("lon"), F.col("lat"), pr.utm_zone(F.col("lon")), F.col("lat") < 0)
    return df.select("lon", "lat", pr.utm_zone(F.col("lon")).alias("zone"), (F.col("lat") < 0).alias("south"), e.alias("e"), n.alias("n"))


def meridian_arc(lat, steps=4000):
    a, f = pr.SEMI_MAJOR, pr.FLATTENING
    e2, h = f * (2 - f), math.radians(lat) / steps
    at = lambda x: a * (1 - e2) / (1 - e2 * math.sin(x) ** 2) ** 1.5
    return sum((at(i * h) + 4 * at((i + 0.5) * h) + at((i + 1) * h)) * h / 6 for i in range(steps))


def test_places_in_a_zone(spark):
    tower = utm(spark, [(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600)]).first()
    assert (tower["zone"], round(tower["e"]), round(tower["n"])) == (17, 630084, 4833439)
    for lat in (0.0, 10.0, 45.0, 80.0, -30.0):
        r = utm(spark, [(69.0, lat)]).first()
        assert r["e"] == pytest.approx(500_000, abs=1e-6) and r["n"] == pytest.approx((10_000_000 if lat < 0 else 0) + math.copysign(0.9996 * meridian_arc(abs(lat)), lat), abs=1e-4)
    assert [r["zone"] for r in utm(spark, [(-180.0, 1.0), (179.99, 1.0), (180.0, 1.0), (66.0, 1.0), (71.999, 1.0)]).collect()] == [1, 60, 1, 42, 42]


def test_degrees_there_and_back(spark):
    rng = random.Random(2)
    df = utm(spark, [(rng.uniform(-180, 180), rng.uniform(-84, 84)) for _ in range(400)])
    lon, lat = pr.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    assert df.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()[0] < 1e-9
    xs, ys = pr.vertices_to_utm(F.array("lon"), F.array("lat"), F.col("zone"), F.col("south"))
    assert df.select(F.max(F.abs(xs[0] - F.col("e")) + F.abs(ys[0] - F.col("n")))).first()[0] < 1e-6


def test_projected_areas(spark):
    """Small squares against the ellipsoid's own area, within the grid's scale."""
    rows = [(lon, lat) for lon in (66.4, 68.99, 71.5) for lat in (-35.0, 0.01, 28.0, 60.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    corners = lambda c, k: F.array(*(F.col(c) + 0.02 * i for i in k))
    df = df.select("x", "y", corners("x", (0, 1, 1, 0)).alias("xs"), corners("y", (0, 0, 1, 1)).alias("ys"), F.lit(42).alias("zone"), (F.col("y") < 0).alias("south"))
    e2 = pr.FLATTENING * (2 - pr.FLATTENING)
    for r in df.select("x", "y", pr.projected_area(F.col("xs"), F.col("ys"), F.col("zone"), F.col("south")).alias("m2")).collect():
        lat = math.radians(r["y"] + 0.01)
        w = 1 - e2 * math.sin(lat) ** 2
        true = pr.SEMI_MAJOR**2 * (1 - e2) / w**2 * math.cos(lat) * math.radians(0.02) ** 2
        assert r["m2"] == pytest.approx(true, rel=1.7e-3) and r["m2"] / true > 0.9991
    assert [tuple(r) for r in pr.estimated_zones(df.where("y < 0")).collect()] == [(42, True)]


def test_pixels_lie_in_their_tile(spark):
    tile = catalog.QUERIES["tile_bounds_lonlat"](spark, SF)
    px = catalog.QUERIES["pixel_lonlat"](spark, SF).selectExpr("*", "row div 10 tr", "col div 10 tc")
    assert px.count() == px.join(tile, ["tr", "tc"]).where("lon between west and east and lat between south and north").count() > 0


def ring(rng, n, size=12.0, ox=10.0, oy=10.0):
    return [ox + size * math.cos(2 * math.pi * (k + rng.random()) / n) * rng.uniform(0.2, 1) for k in range(n)], [oy + size * math.sin(2 * math.pi * (k + rng.random()) / n) * rng.uniform(0.2, 1) for k in range(n)]


def holds(x, y, rings):
    inside = False
    for xs, ys in rings:
        for a in range(len(xs)):
            x1, y1, x2, y2 = xs[a - 1], ys[a - 1], xs[a], ys[a]
            inside ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return inside


def grid(spark, lo, hi):
    return spark.createDataFrame([(r, c) for r in range(lo, hi) for c in range(lo, hi)], "row int, col int")


def test_scanlines(spark):
    rng = random.Random(3)
    shapes = {n: [ring(rng, rng.randrange(3, 12), ox=rng.uniform(-5, 15), oy=rng.uniform(-5, 15))] for n in range(40)}
    shapes |= {100: [([0.0, 9.0, 9.0, 0.0], [0.0, 0.0, 9.0, 9.0]), ([2.5, 2.5, 6.5, 6.5], [2.5, 6.5, 6.5, 2.5])], 101: [([9.0, 12.0, 12.0, 9.0], [0.0, 0.0, 9.0, 9.0])]}  # a hole, and a neighbour
    shapes |= {102: [([1.0, 1.0], [2.0, 2.0])], 103: [([0.5, 5.5, 5.5, 0.5], [0.5, 0.5, 4.5, 4.5])], 104: [([-4.0, -1.0, -2.0], [-4.0, -4.0, -1.0])]}
    df = spark.createDataFrame([(n, f"c{n}", *r) for n, rings in shapes.items() for r in rings], SHAPES)
    px = grid(spark, -8, 24)
    got = {(r["crop"], r["row"], r["col"]) for r in scanline.burn(px, df).collect()}
    assert got == {(f"c{n}", r, c) for n, rings in shapes.items() for r in range(-8, 24) for c in range(-8, 24) if holds(c + 0.5, r + 0.5, rings)}
    inside = {tuple(r) for r in scanline.within(px, df.where("id = 100")).collect()}
    assert inside == {(r, c) for k, r, c in got if k == "c100"} and scanline.within(px, df.where("id = 100"), outside=True).count() == 32 * 32 - len(inside)
    assert scanline.burn(px, df.limit(0)).count() == 0


def test_no_vertices_above_the_spans(spark):
    plan = scanline.burn(grid(spark, 0, 5), stars(spark, str(DATA)))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Window")]
    assert "Join" in above and "xs" not in above and "NestedLoop" not in plan


def meets_square(rings, r, c):
    """Exactly: an edge meets the closed square, or the shape holds its centre."""
    for xs, ys in rings:
        for a in range(len(xs)):
            x1, y1, x2, y2 = map(Fraction, (xs[a - 1], ys[a - 1], xs[a], ys[a]))
            if max(x1, x2) < c or min(x1, x2) > c + 1 or max(y1, y2) < r or min(y1, y2) > r + 1:
                continue
            side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (c, c + 1) for y in (r, r + 1)]
            if min(side) <= 0 <= max(side):
                return True
    return holds(c + 0.5, r + 0.5, rings)


def test_touched_squares(spark):
    rng = random.Random(6)
    shapes = [[ring(rng, 3, ox=rng.uniform(0, 14), oy=rng.uniform(0, 14))] for _ in range(12)]
    shapes += [[([1.3, 15.2, 15.21], [2.1, 13.7, 13.9])], [([4.0, 9.0, 9.0, 4.0], [4.0, 4.0, 6.0, 6.0])], [([0.2, 0.3, 0.25], [0.2, 0.2, 0.3])], [([7.5, 7.5, 7.6], [1.5, 9.5, 5.0])], [([3.2, 8.7, 5.0], [3.5, 3.5, 3.9])]]
    px = grid(spark, -3, 20)
    df = spark.createDataFrame([(n, "x", *r) for n, rings in enumerate(shapes) for r in rings], SHAPES)
    for n, rings in enumerate(shapes):
        got = {tuple(r) for r in scanline.touched(px, df.where(F.col("id") == n)).collect()} if n > 9 else None
        assert got is None or got == {(r, c) for r in range(-3, 20) for c in range(-3, 20) if meets_square(rings, r, c)}
    got = {tuple(r) for r in scanline.touched(px, df).collect()}
    assert got == {(r, c) for r in range(-3, 20) for c in range(-3, 20) if any(meets_square(s, r, c) for s in shapes)}


@pytest.mark.parametrize("block, strip", [(4096, 256), (4, 3), (1, 1)])
def test_sieve_by_runs(spark, monkeypatch, block, strip):
    monkeypatch.setattr(raster, "BLOCK", block)
    monkeypatch.setattr(raster, "STRIP", strip)
    rng = random.Random(7)
    cells = {(r, c) for r in range(15) for c in range(17) if rng.random() < 0.6}
    left, want = set(cells), {}
    while left:
        todo, own = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            own.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        first = min(own)
        want |= dict.fromkeys(own, (first[0] * 2**32 + first[1], len(own), len(own) < 6))
    mask = spark.createDataFrame([*cells, *list(cells)[:9]], "row int, col int")
    assert {(r["row"], r["col"]): (r["comp"], r["size"], r["removed"]) for r in raster.sieved(mask, 6).collect()} == want
    assert raster.sieved(mask.limit(0), 6).collect() == []
    runs = raster.with_runs(mask).select("row", "block", "start").distinct().count()
    assert runs == sum((r, c - 1) not in cells or c % block == 0 for r, c in cells)


def test_forests_of_links():
    import numpy as np

    rng = random.Random(8)
    u, v = np.array([[rng.randrange(60), rng.randrange(60)] for _ in range(45)]).T
    a, b = graph.forest(u, v)
    of = {n: n for n in range(60)}
    for _ in range(60):
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            of[x] = of[y] = min(of[x], of[y])
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {n: r for n, r in of.items() if n != r}


def areas_of(df, *flags):
    return [df.agg(F.coalesce(F.sum(F.when(F.expr(f), ar.trapezoid_area())), F.lit(0.0))).first()[0] for f in flags]


def shape(spark, *rings):
    return spark.createDataFrame([(1, list(map(float, xs)), list(map(float, ys))) for xs, ys in rings], "k long, xs array<double>, ys array<double>")


def test_overlay(spark):
    square, other = shape(spark, ([0, 4, 4, 0], [0, 0, 4, 4])), shape(spark, ([2, 6, 6, 2], [1, 1, 9, 9]))
    flags = ("in0 and in1", "in0 and not in1", "not in0 and in1", "in0 or in1")
    assert areas_of(ar.overlaid(square, other, "k"), *flags) == pytest.approx([6, 10, 26, 42])
    assert areas_of(ar.overlaid(square, square, "k"), *flags) == pytest.approx([16, 0, 0, 16])  # all borders in common
    far, beside, hole = shape(spark, ([9, 10, 9], [0, 0, 1])), shape(spark, ([4, 8, 8, 4], [0, 0, 4, 4])), shape(spark, ([0, 4, 4, 0], [0, 0, 4, 4]), ([1, 3, 3, 1], [1, 1, 3, 3]))
    assert areas_of(ar.overlaid(square, far, "k"), *flags) == pytest.approx([0, 16, 0.5, 16.5])
    assert areas_of(ar.overlaid(square, beside, "k"), *flags) == pytest.approx([0, 16, 16, 32])
    assert areas_of(ar.overlaid(hole, other, "k"), *flags) == pytest.approx([4, 8, 28, 40])


def test_overlay_of_rough_shapes(spark):
    rng = random.Random(11)
    a, b = [ring(rng, 9) for _ in range(6)], [ring(rng, 7, size=9, ox=13) for _ in range(6)]
    frame = lambda rings: spark.createDataFrame([(k, *r) for k, r in enumerate(rings)], "k long, xs array<double>, ys array<double>")
    parts = ar.overlaid(frame(a), frame(b), "k").collect()
    for _ in range(400):
        k, x, y = rng.randrange(6), rng.uniform(-2, 24), rng.uniform(-2, 24)
        at = [r for r in parts if r["k"] == k and r["low"] < y < r["high"]]
        share = lambda r: (y - r["low"]) / (r["high"] - r["low"])
        on = [r for r in at if r["left_low"] + (r["left_high"] - r["left_low"]) * share(r) < x < r["right_low"] + (r["right_high"] - r["right_low"]) * share(r)]
        assert [(r["in0"], r["in1"]) for r in on] == ([want] if any(want := (holds(x, y, [a[k]]), holds(x, y, [b[k]]))) else [])


def test_dissolve(spark):
    shapes = [("a", [0, 4, 4, 0], [0, 0, 4, 4]), ("a", [2, 2, 6, 6], [1, 9, 9, 1]), ("a", [0, 4, 4, 0], [0, 0, 4, 4]), ("b", [0.5, 9.5, 5.0], [0.5, 0.5, 8.0]), ("b", [5.0, 9.5, 0.5], [8.0, 0.5, 0.5])]
    df = spark.createDataFrame([(k, list(map(float, xs)), list(map(float, ys))) for k, xs, ys in shapes], "k string, xs array<double>, ys array<double>")
    for side in (2.5, 100.0):
        got = {r["k"]: r["a"] for r in ar.dissolved(df, side, "k").groupBy("k").agg(F.sum(ar.trapezoid_area()).alias("a")).collect()}
        assert got == {"a": pytest.approx(42), "b": pytest.approx(33.75)}


def test_repair(spark):
    bow = shape(spark, ([0, 2, 2, 0], [0, 2, 0, 2]))
    assert areas_of(ar.repaired(bow, "k"), "true") == pytest.approx([2])
    twice = shape(spark, ([0, 4, 4, 0, 0, 4, 4, 0], [0, 0, 4, 4, 0, 0, 4, 4]))  # each side twice: even, so nothing
    assert areas_of(ar.repaired(twice, "k"), "true") == pytest.approx([0])
    assert ar.repaired(shape(spark, ([0, 5], [0, 5]), ([1], [1])), "k").where(ar.trapezoid_area() > 1e-12).collect() == []
    star = [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]
    parts = ar.repaired(shape(spark, tuple(zip(*star, strict=True))), "k")
    tip = 5 / 2 * (math.sin(4 * math.pi / 5) * 0 + math.tan(math.pi / 10) * math.cos(math.pi / 5) * 0)  # five tips, without the middle
    outer, inner = 1.0, math.cos(2 * math.pi / 5) / math.cos(math.pi / 5)
    tip += 5 * outer * inner * math.sin(math.pi / 5) - 5 / 2 * inner**2 * math.sin(2 * math.pi / 5)
    assert areas_of(parts, "true") == pytest.approx([tip])
    xs, ys = ar.trapezoid_vertices()
    assert spark_rows(parts.select(F.size(xs).alias("n"), F.size(ys).alias("m")))[1][0] == (4, 4)


def distance(x, y, xs, ys):
    best = math.inf
    for a in range(len(xs)):
        dx, dy = xs[a] - xs[a - 1], ys[a] - ys[a - 1]
        t = max(0, min(1, ((x - xs[a - 1]) * dx + (y - ys[a - 1]) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x - xs[a - 1] - t * dx, y - ys[a - 1] - t * dy))
    return best


def test_points_near_shapes(spark):
    rng = random.Random(12)
    shapes = [ring(rng, rng.randrange(3, 9), ox=rng.uniform(-9, 20), oy=rng.uniform(-9, 20)) for _ in range(8)]
    pts = [(i, rng.uniform(-20, 35), rng.uniform(-20, 35)) for i in range(400)]
    p, s = spark.createDataFrame(pts, "p long, x double, y double"), spark.createDataFrame([(k, *r) for k, r in enumerate(shapes)], "id long, xs array<double>, ys array<double>")
    got = sorted(tuple(r) for r in nearness.points_near(p, s, 1.5, "p", "x", "y").collect())
    assert got == sorted((i, k) for i, x, y in pts for k, r in enumerate(shapes) if holds(x, y, [r]) or distance(x, y, *r) <= 1.5)


def test_cells_near_shapes(spark):
    rng = random.Random(13)
    shapes = [ring(rng, rng.randrange(3, 9), size=rng.choice([0.6, 4]), ox=rng.uniform(0, 14), oy=rng.uniform(0, 14)) for _ in range(6)]
    s = spark.createDataFrame([(k, *r) for k, r in enumerate(shapes)], "id long, xs array<double>, ys array<double>")
    cells = spark.createDataFrame([(i, j) for i in range(-4, 20) for j in range(-4, 20)], "i long, j long")
    got = {tuple(r) for r in nearness.cells_near(cells, s, 1.0, 0.7).collect()}

    def near(i, j, xs, ys):
        if meets_square([(xs, ys)], j, i) or any(distance(x, y, xs, ys) <= 0.7 for x in (i, i + 1) for y in (j, j + 1)):
            return True
        return any(math.hypot(max(i - x, x - i - 1, 0), max(j - y, y - j - 1, 0)) <= 0.7 for x, y in zip(xs, ys, strict=True))

    assert got == {(i, j) for i in range(-4, 20) for j in range(-4, 20) if any(near(i, j, *r) for r in shapes)}
    with pytest.raises(ValueError):
        nearness.cells_near(cells, s, 1.0, 1.1)


@pytest.mark.parametrize("name", ["buffered_exclusion", "points_near_areas", "clip_polygons", "scanline_burn"])
def test_no_nested_loops(spark, name):
    assert "NestedLoop" not in catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


def test_union_is_its_outer_sides(spark, monkeypatch):
    """Shapes upon one another leave few trapezoids, copies count once, and cells too full for one task give the same area."""
    rng = random.Random(5)
    rows = [(k % 2, *ring(rng, 5, size=3, ox=rng.uniform(0, 3), oy=rng.uniform(0, 3))) for k in range(40)]
    df = spark.createDataFrame(rows + rows, "k long, xs array<double>, ys array<double>")
    area = lambda parts: {r["k"]: r["a"] for r in parts.groupBy("k").agg(F.sum(ar.trapezoid_area()).alias("a")).collect()}
    parts = ar.dissolved(df, 4.0, "k").persist()
    light, n = area(parts), parts.count()
    assert n < 20 * len(rows)
    monkeypatch.setattr(ar, "MANY", 8)
    assert area(ar.dissolved(df, 4.0, "k")) == pytest.approx(light, rel=1e-9)
    monkeypatch.setattr(ar, "MANY", 1000)
    for name in ("PAIRS", "SIDES"):
        monkeypatch.setattr(ar, name, 64)
    one = [np.array(v) for v in ([0.0, 2, 1, 3], [0.0, 0, 1, 1], [0.0, 2, 1, 3], [2.0, 2, 3, 3], [1, -1, 1, -1])]
    got = ar._union(*one)
    assert sorted(map(tuple, got.T)) == [(0, 1, 0, 0, 2, 2), (1, 2, 0, 0, 3, 3), (2, 3, 1, 1, 3, 3)]


def test_a_clip_step_is_computed_once(spark):
    """A filter on what is left of a shape must not multiply the steps before."""
    df = spark.createDataFrame([(1, [0.0, 4.0, 0.0], [0.0, 0.0, 4.0])], "id long, xs array<double>, ys array<double>")
    cut = geo.clipped_to_box(df, *map(F.lit, (1.0, 1.0, 2.0, 2.0))).where(F.size("xs") > 2)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("zip_with") < 20


def test_pairs_of_points_and_areas_are_not_shuffled(spark):
    """Many points at few places near many equal areas; an area of two rings, a point at two places, a hole."""
    square = lambda a, b: ([a, b, b, a], [a, a, b, b])
    shapes = [(k, *square(0.0, 5.0)) for k in range(100)] + [(200, *square(0.0, 5.0)), (200, *square(1.5, 3.5)), (300, *square(20.0, 20.2)), (300, *square(20.4, 20.6))]
    at = [(2.5, 2.5), (0.5, 0.5), (20.1, 20.1), (9.0, 9.0)]
    rows = [(i, *at[i % 4]) for i in range(400)] + [(400, 2.5, 2.5), (400, 0.5, 0.5), (401, None, 1.0)]
    pts = spark.createDataFrame(rows, "p long, x double, y double")
    areas = spark.createDataFrame(shapes, "id long, xs array<double>, ys array<double>")
    got = nearness.points_near(pts, areas, 0.3, "p", "x", "y")
    pairs = sorted(map(tuple, got.collect()))
    near = {0: set(range(100)), 1: {*range(100), 200}, 2: {300}, 3: set()}
    want = {(i, k) for i in range(400) for k in near[i % 4]} | {(400, k) for k in near[1]}
    assert pairs == sorted(want)
    store, sc = spark._jsc.sc().statusStore(), spark.sparkContext
    sc.setJobGroup("near", "near")
    nearness.points_near(pts, areas, 0.3, "p", "x", "y").write.format("noop").mode("overwrite").save()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("near") for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 10_000 < len(pairs)
