"""Curves: smoothing, contracts, profiles."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracurve import schema
from terracurve.functions import curve as c
from terracurve.operators import profiles


def test_date_axis(spark):
    dates = spark.range(1).select(c.date_axis("2025-04-01", 35)).first()[0]
    assert [d.isoformat() for d in dates] == schema.DATES and schema.DATES[-1] == "2025-12-29"


def test_hat_matrix_keeps_lines():
    h = c.hat_matrix(35)
    assert np.allclose(h.sum(axis=1), 1)
    line = 0.2 + 0.01 * np.arange(35)
    assert np.allclose(h @ line, line)


@settings(deadline=None, max_examples=30)
@given(st.lists(st.one_of(st.none(), st.floats(-0.99, 0.99)), min_size=12, max_size=12))
def test_smoothing_with_gaps(values):
    y = np.array([[np.nan if v is None else v for v in values]])
    z = c.smoothed(y)[0]
    seen = ~np.isnan(y[0])
    if seen.sum() < 2:
        assert np.isnan(z).all()
        return
    p = c.penalty_matrix(12)
    want = np.clip(np.linalg.solve(np.diag(seen.astype(float)) + p, np.where(seen, np.nan_to_num(y[0]), 0)), -1, 1)
    assert np.allclose(z, want)
    if seen.all():
        assert np.allclose(z, np.clip(c.hat_matrix(12) @ y[0], -1, 1))


def test_smooth_udf_agrees_with_complete(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.uniform(-0.5, 0.5, 20)]) for i in range(5)] + [(9, None), (10, [None] * 19 + [0.5])]
    df = spark.createDataFrame(rows, "id int, curve array<double>")
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", c.smooth("curve").alias("a"), c.smooth_complete(F.col("curve"), 20).alias("b")).collect()}
    assert all(np.allclose(*got[i]) for i in range(5))
    assert got[9][0] is None and got[10][0] is None


def test_contract():
    schema.require_dates([*schema.DATES, "label"])
    with pytest.raises(schema.ContractError, match="out of order"):
        schema.require_dates([schema.DATES[1], schema.DATES[0], *schema.DATES[2:]])
    with pytest.raises(schema.ContractError, match="absent"):
        schema.require_dates(schema.DATES[:17] + schema.DATES[18:])


def humps(spark, seed=101):
    """480 separable curves: four classes, each a plateau that begins and ends at its own places, on three tiles."""
    rng, rows = np.random.default_rng(seed), []
    steps = {1: (20, 30), 2: (10, 16), 3: (2, 7), 6: (16, 33)}
    for n in range(480):
        label, tile = list(steps)[n % 4], f"field-{n // 4 % 3}"
        first, last = steps[label]
        x = np.where((np.arange(35) >= first) & (np.arange(35) <= last), 0.7, 0.1) + rng.uniform(-0.08, 0.08, 35)
        rows.append((label, tile, x.tolist()))
    return spark.createDataFrame(rows, "label int, tile string, curve array<double>")


def test_nearest_profile_of_separable_curves(spark):
    df = humps(spark)
    got = profiles.nearest(profiles.profile_distances(df, profiles.median_profiles(df)))
    assert got.where("nearest = label").count() == 480
    assert profiles.leave_one_out(df, "tile", 1).where("agreement_pct = 100").count() == 3
    assert profiles.drop_near(df, profiles.median_profiles(df), 1).count() == 360
    assert profiles.drop_near(df, profiles.median_profiles(df.where("label <> 1")), 1).count() == 480


def test_forest_and_hold_out(spark):
    from terracurve.operators import learning as ml

    df = ml.features(humps(spark))
    train, test, absent = ml.hold_out(df, "tile")
    tiles = lambda d: {r["tile"] for r in d.select("tile").distinct().collect()}
    assert not tiles(train) & tiles(test) and not absent
    model = ml.fit(ml.balanced(train), trees=10, depth=8)
    pred = ml.predict(model, test)
    assert ml.macro_f1(pred) > 0.95
    assert pred.where("label = 1").agg(F.min("p")).first()[0] > 0.5
    assert abs(sum(r["importance"] for r in ml.importance(spark, model, schema.DATES).collect()) - 1) < 1e-6
    assert ml.search(df, "tile", 0)[0]["value"] is None
    with pytest.raises(ValueError):
        ml.hold_out(df.where("tile = 'field-1'"), "tile")


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(0, 30), st.dictionaries(st.integers(1, 4), st.integers(1, 50), min_size=1), min_size=2, max_size=12), st.integers(2, 4))
def test_folds_keep_groups_whole(counts, folds):
    from terracurve.operators import learning as ml

    got = ml.assign_folds(counts, folds)
    assert set(got) == set(counts) and set(got.values()) <= set(range(folds))
