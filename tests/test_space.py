"""Pixels, geometry, selection, files, streams."""

import random

import pytest
from pyspark.sql import functions as F

from terracurve.functions import geo
from terracurve.operators import raster, sampling, selection
from terracurve.plans import catalog
from terracurve.sources import io
from tests.compare import DATA


def test_golden_raster(spark):
    rows = catalog.QUERIES["burn_erode_ambiguity"](spark, str(DATA)).where("r_name = 'ASIA'").collect()
    assert {r["crop"]: r["n"] for r in rows} == {"cotton": 16, "rice": 12, "sugarcane": 8}


def mask(spark, cells):
    return spark.createDataFrame(sorted(cells), "row int, col int")


def test_erosion_and_sieve(spark):
    rng = random.Random(4)
    cells = {(r, c) for r in range(14) for c in range(14) if rng.random() < 0.75}
    got = {tuple(x) for x in raster.eroded(mask(spark, cells)).collect()}
    assert got == {(r, c) for r, c in cells if all((r + a, c + b) in cells for a in (-1, 0, 1) for b in (-1, 0, 1))}
    some = {x for x in cells if rng.random() < 0.6}
    left, sizes = set(some), {}
    while left:
        todo, own = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            own.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        sizes |= dict.fromkeys(own, len(own))
    assert {(x["row"], x["col"]): x["size"] for x in raster.sieved(mask(spark, some), 5).collect()} == sizes


def test_geometry(spark):
    df = spark.createDataFrame([([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 2.0, 2.0])], "xs array<double>, ys array<double>")
    x, y = geo.centroid(F.col("xs"), F.col("ys"))
    r = df.select(geo.area(F.col("xs"), F.col("ys")).alias("a"), x.alias("x"), y.alias("y"), geo.clipped_area(F.col("xs"), F.col("ys"), F.lit(1.0), F.lit(1.0), F.lit(9.0), F.lit(9.0)).alias("c")).first()
    assert tuple(r) == (8.0, 2.0, 1.0, 3.0)
    rows = [([0.0, 4.0, 2.0], [0.0, 0.0, 4.0], 6.0), ([1.0, 3.0, 3.0], [1.0, 1.0, 1.5], 0.5), ([9.0, 10.0, 9.0], [0.0, 0.0, 1.0], None), ([-9.0, 9.0, 9.0, -9.0], [-9.0, -9.0, 9.0, 9.0], 8.0)]
    cut = geo.clipped_to_box(spark.createDataFrame(rows, "xs array<double>, ys array<double>, want double"), *map(F.lit, (0.0, 0.0, 4.0, 2.0)))
    for r in cut.select("want", F.size("xs").alias("n"), F.when(F.size("xs") > 2, geo.area(F.col("xs"), F.col("ys"))).alias("got")).collect():
        assert r["n"] == 0 if r["want"] is None else r["got"] == pytest.approx(r["want"])


def cell(i, j, score, south=False, **classes):
    return {"i": i, "j": j, "score": score, "south": south, "cotton": 1, "rice": 0, "sugarcane": 0, "orchard": 0} | classes


def test_selection():
    cells = [cell(i, j, 100 - i - j, south=j < 4) for i in range(12) for j in range(12)]
    cells.sort(key=lambda c: -c["score"])
    got = selection.chosen_by(selection.CELL_RULES, cells)
    assert len(got) == selection.WANT
    assert selection.SOUTH_MIN <= sum(c["south"] for c in got) <= selection.SOUTH_MAX
    far = selection.chosen_by([selection.Rule(lambda c: True, 9, 4)], cells)
    assert all(max(abs(a["i"] - b["i"]), abs(a["j"] - b["j"])) >= 4 for a in far for b in far if a is not b)
    negatives = selection.chosen_by(selection.negative_rules(), cells)
    assert len(negatives) == 4 and [c["south"] for c in negatives[:2]] == [False, True]


def by_rule(cells):
    """The pilot's places, step by step."""
    pilot = []
    while len(pilot) < 6:
        free = [c for c in cells if c not in pilot]
        south = sum(c["south"] for c in pilot)
        fit = [c for c in free if not c["south"]] if south >= 3 else [c for c in free if c["south"]] if 2 - south >= 6 - len(pilot) else free
        covered = {k for c in pilot for k in selection.REQUIRED if c[k] > 0}
        pilot.append(max(fit or free, key=lambda c: (sum(c[k] > 0 and k not in covered for k in selection.REQUIRED), c["score"], -c["place"])))
    for k in selection.REQUIRED:
        more = [c for c in cells if c not in pilot and c[k] > 0]
        if more and not any(c[k] > 0 for c in pilot):
            pilot.remove(min(pilot, key=lambda c: (c["score"], c["place"])))
            pilot.append(max(more, key=lambda c: (c["score"], -c["place"])))
    return {c["place"] for c in pilot}


def test_pilots(spark):
    rng, names = random.Random(9), ["cotton", *[k for k in selection.REQUIRED if k != "cotton"]]
    columns = ["place", "i", "j", "score", "south", *names]
    for n in (16, 16, 16, 16, 7, 6, 5, 0):
        few = rng.random() * 0.4
        cells = [{"place": p, "i": p, "j": p, "score": float(rng.randrange(4)), "south": rng.random() < rng.choice([0.1, 0.5])} | {k: float(rng.random() < few) for k in names} for p in range(1, n + 1)]
        df = spark.createDataFrame([tuple(c[k] for k in columns) for c in cells], "place int, i long, j long, score double, south boolean, " + ", ".join(f"{k} double" for k in names))
        got = selection.pilot_and_rest(df).collect()
        assert len(got) == (n if n >= 6 else 0) and {r["place"] for r in got if r["batch"] == "pilot"} == (by_rule(cells) if n >= 6 else set())


def test_rates_of_cuts(spark):
    from terracurve.operators import evaluate

    rows = [("a", 0.1), ("a", 0.5), ("a", 0.5), ("a", None), ("b", None), ("c", 0.9)]
    got = {(r["k"], r["cut"]): r["pct"] for r in evaluate.rates(spark.createDataFrame(rows, "k string, p double"), "p", [0.9, 0.5, 0.05], "k").collect()}
    assert got == {("a", 0.05): 100, ("a", 0.5): pytest.approx(200 / 3), ("a", 0.9): 0, ("b", 0.05): None, ("b", 0.5): None, ("b", 0.9): None, ("c", 0.05): 100, ("c", 0.5): 100, ("c", 0.9): 100}


def test_bins_follow_the_values(spark):
    from terracurve.operators.running import value_bin

    rng = random.Random(10)
    xs = sorted([0.0, 1.0, -1.0, 2.0**-1070, -(2.0**1000), 1e308, *(2.0**k * (1 - 2.0**-53) for k in range(-60, 60)), *(2.0**k for k in range(-60, 60)), *(rng.gauss(0, 1) * 10 ** rng.randrange(-9, 9) for _ in range(2000))])
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r["b"] for r in df.select("x", value_bin(F.col("x")).alias("b")).orderBy("x").collect()]
    assert got == sorted(got) and len(set(got)) > 1500


def test_quotas(spark):
    df = spark.createDataFrame([(i, i % 2, i < 6) for i in range(100)], "id int, label int, bad boolean")
    got = sampling.hard_easy(df, 10, 0.5, F.col("bad"), F.col("id"), 1, "label").collect()
    for label in (0, 1):
        own = [r for r in got if r["label"] == label]
        assert (sum(r["is_hard"] for r in own), sum(not r["is_hard"] for r in own)) == (3, 7)
    assert sampling.cap(df, 7, F.col("id"), 1, "label").count() == 14


def test_files(spark, tmp_path):
    boxes = spark.createDataFrame([(i, float(i), i + 1.0, 0.0, 1.0, "x") for i in range(100)], "id int, xmin double, xmax double, ymin double, ymax double, crop string")
    boxes.write.parquet(f"{tmp_path}/boxes")
    df = io.scan_boxed(spark, f"{tmp_path}/boxes", (10.5, 0, 12.5, 1), ["id"])
    assert sorted(r["id"] for r in df.collect()) == [10, 11, 12]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(xmax" in plan and "crop" not in plan.split("ReadSchema")[1]
    boxes.coalesce(1).write.parquet(f"{tmp_path}/one")
    part = next((tmp_path / "one").glob("part-*.parquet"))
    (tmp_path / "stems").mkdir()
    part.rename(tmp_path / "stems" / "faran_1__v2.parquet")
    assert io.scan_stems(spark, f"{tmp_path}/stems").select("aoi").distinct().collect()[0][0] == "faran_1"
    dates = ["2025-04-01", "2025-04-09"]
    rows = [("a", 1, "cotton", "Centroid", 5, 0.5, 0.25, None)]
    io.write_csv(spark.createDataFrame(rows, io.cluster_schema(dates)), f"{tmp_path}/csv")
    assert [tuple(r) for r in io.scan_clusters(spark, f"{tmp_path}/csv", dates).collect()] == rows
    assert io.write_missing(spark, boxes.where("id < 10"), f"{tmp_path}/grown", "id") == 10
    assert io.write_missing(spark, boxes, f"{tmp_path}/grown", "id") == 90
    assert spark.read.parquet(f"{tmp_path}/grown").count() == 100
    made = []
    make = lambda: made.append(1) or boxes
    for refresh in (False, False, True):
        assert io.cached(spark, f"{tmp_path}/cache", make, refresh).count() == 100
    assert len(made) == 2
    assert tuple(io.extent(boxes).first()) == (0.0, 0.0, 100.0, 1.0)


def test_stream_composite(spark, tmp_path):
    from terracurve.streaming.composite import composite

    rows = [("a", "2025-04-01 00:00:00", 1.0), ("a", "2025-04-02 00:00:00", 3.0), ("b", "2025-04-20 00:00:00", 5.0), ("z", "2025-06-20 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "k string, at string, v double").selectExpr("k", "cast(at as timestamp) at", "v")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = composite(stream, "at", "v", "k").writeStream.outputMode("append").format("memory").queryName("composites").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["k"], r["n"], r["mean"]) for r in spark.sql("select * from composites").collect()}
    assert got == {("a", 2, 2.0), ("b", 1, 5.0)}
