"""Stored features, broken files, streams, cards and the search for parameters."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from terracurve.operators import learning as ml
from terracurve.plans import catalog
from terracurve.schema import CODES, DATES, ContractError
from terracurve.session import scratch, sweep
from terracurve.sources import io, lattice, probe
from terracurve.streaming.composite import composite_files
from tests.compare import DATA, duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["lattice_walk", "vector_window", "vector_extent", "tile_probe", "tolerant_sources", "stream_composite", "card_guard", "polygon_acres", "multi_file_scan", "csv_with_bad_lines", "cached_table", "raster_roundtrip", "pilot_batch_split", "batch_report"])
def test_sql(spark, name):
    got = spark_rows(catalog.QUERIES[name](spark, SF))
    assert got[1] and got == duck_rows(duck(SF).sql(catalog.SQL[name]))


def squares(spark, n, size=0.5):
    rng = random.Random(5)
    at = [(i, rng.uniform(0, 100), rng.uniform(-50, 50)) for i in range(n)]
    return spark.createDataFrame([(i, [x, x + size, x + size, x], [y, y, y + size, y + size]) for i, x, y in at], "id long, xs array<double>, ys array<double>")


def test_curve_keys(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x in range(8) for y in range(8)], "x double, y double")
    key = lattice.morton(F.col("x"), F.col("y"), *(F.lit(float(v)) for v in (0, 0, 8, 8)))
    got = {(r["x"], r["y"]): r["k"] >> 26 for r in df.select("x", "y", key.alias("k")).collect()}
    assert got == {(x, y): sum((int(x) >> b & 1) << 2 * b | (int(y) >> b & 1) << 2 * b + 1 for b in range(3)) for x, y in got}
    edge = spark.range(1).select(lattice.morton(F.lit(8.0), F.lit(None).cast("double"), *(F.lit(float(v)) for v in (0, 0, 8, 8))).alias("k"), lattice.morton(F.lit(1.0), F.lit(1.0), *[F.lit(1.0)] * 4).alias("z")).first()
    assert (edge["k"], edge["z"]) == (0x55555555, 0)


def scanned(df):
    """Rows that the scan of an executed frame gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size() or "AdaptiveSparkPlan" in plan.getClass().getSimpleName():
        plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getSimpleName() else plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_windows_skip_row_groups(spark, tmp_path):
    shapes = squares(spark, 20_000)
    lattice.write_along_curve(shapes, f"{tmp_path}/curve", 2, **{"parquet.block.size": "65536", "parquet.block.row.check.min": "100", "parquet.block.size.row.check.min": "100", "parquet.page.size": "8192"})
    window = (10.0, -20.0, 20.0, -10.0)
    got = io.scan_boxed(spark, f"{tmp_path}/curve", window, ["id"])
    wanted = lattice.boxed(shapes).where("xmax >= 10 and xmin <= 20 and ymax >= -20 and ymin <= -10").select("id")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in wanted.collect())
    assert scanned(got) < 20_000 / 4  # the others weren't decoded
    assert tuple(lattice.stored_extent(spark, f"{tmp_path}/curve").first()) == tuple(io.extent(lattice.boxed(shapes)).first())
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_walks(spark, tmp_path):
    shapes = squares(spark, 300, 3.0)
    lattice.write_lattice(shapes, f"{tmp_path}/blocks", 10.0)
    stored = spark.read.parquet(f"{tmp_path}/blocks")
    assert stored.count() > 300  # those on borders stand in several blocks
    every = lattice.walked(spark, f"{tmp_path}/blocks", stored.select("bi", "bj"), 10.0)
    assert sorted(r["id"] for r in every.collect()) == list(range(300))
    wanted = spark.createDataFrame([(2, -1, "a"), (3, 0, "a"), (5, 5, "b")], "bi long, bj long, k string").where("k = 'a'")
    some = lattice.walked(spark, f"{tmp_path}/blocks", wanted, 10.0)
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()
    mid = shapes.select("id", F.floor((F.col("xs")[0] + 1.5) / 10).alias("i"), F.floor((F.col("ys")[0] + 1.5) / 10).alias("j"))
    assert sorted(r["id"] for r in some.collect()) == sorted(r["id"] for r in mid.where("(i = 2 and j = -1) or (i = 3 and j = 0)").collect())


def test_tiles_of_several_files(spark, tmp_path):
    rows = [(t, f"2025-04-{1 + 8 * k:02d}", float(t), 1) for t in (1, 2, 3) for k in range(3 if t < 3 else 2)]
    df = spark.createDataFrame(rows, "tile int, date string, price double, n long").withColumn("date", F.col("date").cast("date"))
    io.write_tiles(df, f"{tmp_path}/t")
    schema = df.drop("tile").schema
    df.where("tile = 2").drop("tile").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t/tile=2")
    broken = probe.listing(spark, f"{tmp_path}/t/tile=2").limit(1).collect()[0]["file"]
    probe.cut_off(spark, broken)
    tiles = spark.createDataFrame([("1",), ("2",), ("3",), ("9",)], "tile string")
    got = {r["tile"]: (r["n_dates"], r["status"]) for r in probe.probed(spark, f"{tmp_path}/t", tiles, schema, "2025-04-01", "2025-04-30", 3).collect()}
    assert got["1"] == (3, "complete") and got["2"][1] == "broken" and got["3"] == (2, "short") and got["9"] == (0, "absent")
    assert probe.probed(spark, f"{tmp_path}/t", tiles, schema, "2025-04-01", "2025-04-10", 2).where("tile = '1'").first()["status"] == "complete"
    found = probe.tolerant(spark, {"a": f"{tmp_path}/t/tile=1", "b": f"{tmp_path}/none"}, schema)
    assert found.count() == 3 and found.select("source").distinct().collect()[0][0] == "a"
    assert probe.tolerant(spark, {"b": f"{tmp_path}/none"}, schema).count() == 0


def test_composites_after_a_stop(spark, tmp_path):
    rows = [("a", f"2025-04-{d:02d} 0{d % 9}:00:00", float(d)) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "k string, at string, v double").selectExpr("k", "cast(at as timestamp) at", "v")
    for first, last in ((1, 10), (11, 19), (20, 28)):
        df.where(F.dayofmonth("at").between(first, last)).write.mode("append").parquet(f"{tmp_path}/in")
        composite_files(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/state", "at", "v", "k", days=4, start="0 days", late="1 day")
    got = {r["end_date"].isoformat(): (r["n"], r["mean"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = df.groupBy(F.window("at", "4 days").alias("w")).agg(F.count("v").alias("n"), F.avg("v").alias("m")).select(F.col("w.end").cast("date").alias("e"), "n", "m").collect()
    assert got == {r["e"].isoformat(): (r["n"], r["m"]) for r in whole if r["e"].isoformat() <= "2025-04-27"} and len(got) > 4


def test_lines_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key,price,day\n1,2.5,2025-04-01\n2,x,2025-04-01\n3,1.0,never\n4\n,,\n")
    from terracurve.plans.storage import _LINES

    got = {r["bad_record"]: (r["key"], r["price"]) for r in io.scan_csv(spark, f"{tmp_path}/a.csv", _LINES).where("bad_record is not null").collect()}
    assert {k.split(",")[0] for k in got} == {"2", "3", "4"} and got["2,x,2025-04-01"] == (2, None) and got["3,1.0,never"] == (3, 1.0)
    assert len(io.scan_csv(spark, f"{tmp_path}/a.csv", _LINES).select("key", "bad_record").where("bad_record is null").collect()) == 2


def test_caches_follow_their_sources(spark, tmp_path):
    source, made = f"{tmp_path}/s", []
    spark.range(5).write.parquet(source)
    make = lambda: made.append(1) or spark.read.parquet(source)
    read = lambda: io.cached_while(spark, f"{tmp_path}/c", make, source).count()
    assert (read(), read(), len(made)) == (5, 5, 1)
    spark.range(3).write.mode("append").parquet(source)
    assert (read(), read(), len(made)) == (8, 8, 2)
    spark.range(2).write.mode("overwrite").parquet(source)
    assert (read(), len(made)) == (2, 3)
    # A version that was cut off before it was whole isn't used.
    version = max((tmp_path / "c").iterdir(), key=lambda p: p.stat().st_mtime)
    shutil.rmtree(version / "done")
    assert (read(), len(made)) == (2, 4)


def test_rasters_are_read_by_blocks(spark, tmp_path):
    px = spark.range(900).selectExpr("cast(id div 30 as int) row", "cast(id % 30 as int) col", "id * 2 v")
    io.write_raster(px, f"{tmp_path}/r", 8, {"crs": "EPSG:32642"})
    df, told = io.read_raster(spark, f"{tmp_path}/r", (3, 9, 20, 25))
    assert told == {"crs": "EPSG:32642", "side": 8, "bands": ["v"]}
    assert {tuple(r) for r in df.select("row", "col", "v").collect()} == {(r, c, 2 * (30 * r + c)) for r in range(3, 10) for c in range(20, 26)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_row" in plan and io.read_raster(spark, f"{tmp_path}/r")[0].count() == 900


def test_files_by_name(spark, tmp_path):
    for n, df in (("b__1", spark.range(2)), ("a__1", spark.range(3).withColumn("x", F.lit("y")))):
        io.write_named(df, f"{tmp_path}/f/{n}.parquet")
    io.write_named(spark.range(4), f"{tmp_path}/f/b__1.parquet")  # in the place of the first
    got = io.scan_files(spark, f"{tmp_path}/f/*.parquet")
    assert sorted((r["file"], r["id"], r["x"]) for r in got.collect()) == [("a__1.parquet", i, "y") for i in range(3)] + [("b__1.parquet", i, None) for i in range(4)]


def test_forest_of_capped_rows(spark):
    got = catalog.QUERIES["capped_group_forest"](spark, SF).collect()
    assert {r["label"] for r in got} == set(range(10)) and all(r["n_train"] + r["n_test"] == r["n_capped"] <= 30 for r in got)
    assert sum(r["n_test"] for r in got) > 0 and all(r["hits"] <= r["n_test"] for r in got)


def test_cards():
    card = {"dates": DATES, "codes": CODES}
    assert ml.check_card(["tile", *DATES, "x"], CODES, card) == DATES
    for columns, codes in ((DATES[::-1], CODES), (DATES[1:], CODES), ([*DATES, "2026-02-01"], CODES), (DATES, CODES | {"new": 9}), (DATES, {k: v for k, v in CODES.items() if k != "rice"})):
        with pytest.raises(ContractError):
            ml.check_card(columns, codes, card)


def best_of(objective, trials, seed, tpe):
    rng, tried = random.Random(seed), []
    space = {"a": range(1, 41), "b": range(8, 31), "c": ["x", "y", "z"]}
    for _ in range(trials):
        params = ml.suggested(space, tried if tpe else [], rng)
        tried.append((params, objective(params)))
    return max(v for _, v in tried)


@pytest.mark.parametrize("peak", [(31, 12, "x"), (7, 25, "y")])
def test_parzen_beats_random(peak):
    objective = lambda p: -(abs(p["a"] - peak[0]) / 10) - abs(p["b"] - peak[1]) / 6 - 0.5 * (p["c"] != peak[2])
    runs = [(best_of(objective, 40, s, True), best_of(objective, 40, s, False)) for s in range(40)]
    assert sum(a for a, _ in runs) / 40 > sum(b for _, b in runs) / 40 + 0.05
    assert sum(a >= b for a, b in runs) > 24
    assert best_of(objective, 30, 3, True) == best_of(objective, 30, 3, True)


def test_search_by_parzen(spark, monkeypatch):
    monkeypatch.setattr(ml, "START", 2)
    rng = random.Random(1)
    rows = [(t, k, [rng.gauss(k, 0.6), rng.gauss(-k, 0.6)]) for t in range(6) for k in (0, 1) for _ in range(12)]
    df = ml.features(spark.createDataFrame(rows, "tile int, label int, curve array<double>"))
    space = {"trees": [2, 4], "depth": [1, 3], "leaf": [1, 5], "features": ["sqrt"]}
    got = ml.search(df, "tile", 4, 2, space=space)
    assert len(got) == 4 and all(0 <= t["value"] <= 1 for t in got) and ml.search(df, "tile", 4, 2, space=space) == got
    assert ml.search(df, "tile", 0)[0]["trees"] == 250
    train, test, lacking = ml.hold_out(df, "tile")
    assert lacking == [] and train.columns == df.columns and not {r[0] for r in train.select("tile").collect()} & {r[0] for r in test.select("tile").collect()}


def test_swept_folder(spark):
    path = scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    sweep(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert catalog.QUERIES["vector_extent"](spark, str(DATA)).count() == 1
