"""Chained queries on tables that are large enough to fill their shapes, and what has no SQL."""

import statistics

import pytest

from terracurve.operators import profiles, running, tiles
from terracurve.plans import catalog, chains
from terracurve.sources.adapters import polygons
from terracurve.schema import CODES
from tests.compare import duck, duck_rows, spark_rows
from terracurve.plans.pixels import _GOLDEN

SF = "/root/testdata/sf0.01"
NAMES = ["tile_labelled_rows", "labelled_blocks", "negative_cells", "generic_negatives", "leave_one_group_out_profile", "matched_recall", "hard_easy_quota", "contradictory_pairs"]


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, name):
    got = spark_rows(catalog.QUERIES[name](spark, SF))
    assert got[1] and got == duck_rows(duck(SF).sql(catalog.SQL[name]))


def test_golden_tile(spark):
    px = spark.range(400).selectExpr("cast(id div 20 as int) row", "cast(id % 20 as int) col", "array(1d, 2d, 1d, null) red", "if(id = 63, array(null, null, null, null), array(3d, 2d, 5d, 1d)) nir")
    got = tiles.labelled_rows(px, polygons(spark, _GOLDEN), CODES, (10.0, 50.0), (0.5, -0.5), (1, 2)).collect()
    n = {c: sum(r["crop"] == c for r in got) for c in CODES}
    assert (n["cotton"], n["rice"], n["sugarcane"]) == (15, 12, 8)  # one of 16 has no value
    assert all(r["code"] == CODES[r["crop"]] and len(r["curve"]) == 2 and (r["lon"], r["lat"]) == (10 + (r["col"] + 0.5) / 2, 50 - (r["row"] + 0.5) / 2) for r in got)
    assert tiles.labelled_rows(px.limit(0), polygons(spark, _GOLDEN), CODES, (0.0, 0.0), (1.0, 1.0)).count() == 0


def test_pixels_are_never_broadcast(spark, monkeypatch):
    """Files of pixels are small beside the arrays made of them; few labels and many give the same rows."""
    found = []
    for few in (tiles.FEW, 0):
        monkeypatch.setattr(tiles, "FEW", few)
        df = catalog.QUERIES["tile_labelled_rows"](spark, SF)
        assert "BuildLeft" not in df._jdf.queryExecution().executedPlan().toString()
        found.append(spark_rows(df))
    assert found[0][1] and found[0] == found[1]
    assert "BroadcastHashJoin" not in catalog.QUERIES["scanline_burn"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_quantiles_are_exact(spark):
    rows = [("a", float(x)) for x in [3, 1, 2, 2, 2, 9.5, -4]] + [("b", 0.001 * i) for i in range(100)] + [("b", None), ("c", None), (None, 7.0)]
    got = {r["g"]: (r["q0"], r["q1"]) for r in running.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], [0.5, 0.9]).collect()}
    assert set(got) == {"a", "b", None} and got[None] == (7.0, 7.0)
    assert got["a"][0] == 2 and got["b"][0] == pytest.approx(0.0495) and got["b"][1] == pytest.approx(0.0891)


def test_medians_without_a_group(spark):
    rows = [(g, k, [float((g * 7 + k * 3 + i * i) % 5), 1.0 * i]) for g in range(4) for k in range(3) for i in range(2 + g) if (g, k) != (1, 2)]
    rows += [(9, 5, [1.0, 2.0])]  # a class that one group has alone
    df = spark.createDataFrame(rows, "tile int, label int, curve array<double>")
    got = {(r["held"], r["label"]): r["profile"] for r in profiles.medians_without(df, "tile").collect()}
    assert set(got) == {(g, k) for g, k, _ in rows}
    for (g, k), p in got.items():
        rest = [c for h, j, c in rows if j == k and h != g]
        assert p is None if not rest else p == [statistics.median(c[i] for c in rest) for i in range(2)]


def test_models_and_names(spark):
    assert all(r["same"] for r in catalog.QUERIES["rf_saved_model"](spark, SF).collect())
    one = catalog.QUERIES["rf_kfold_report"](spark, SF).first()
    assert one["folds"] == 3 and 0 <= one["least"] <= one["mean"] <= one["greatest"] <= 1
    df = spark.createDataFrame([("a.b",), ("axb",), ("a.b\n",)], "n string")
    assert [r["n"] for r in df.where(chains.io.matches_glob(df["n"], "a.?")).collect()] == ["a.b"]
