"""Every registered query against its SQL on the smallest tables, and the rest for their rows."""

import numpy as np
import pytest

from tests.compare import DATA, duck, duck_rows, spark_rows
from terracurve.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    assert spark_rows(catalog.QUERIES[name](spark, str(DATA))) == duck_rows(con.sql(SQL[name]))


def rows_of(spark, name):
    return catalog.QUERIES[name](spark, str(DATA)).collect()


def test_feature_contract_guard(spark):
    got = {r["name"]: (r["refused"], r["message"]) for r in rows_of(spark, "feature_contract_guard")}
    assert not got.pop("good")[0] and len(got) == 7 and all(refused for refused, _ in got.values())
    parts = {"reordered": "out of order", "dropped": "absent", "unknown_code": "unknown label", "no_tile": "tile is missing", "not_finite": "non-finite", "one_class": "two classes", "one_tile": "two tiles"}
    assert all(part in got[name][1] for name, part in parts.items())


def test_hold_out_and_forests(spark):
    folds = rows_of(spark, "group_holdout_assignment")
    assert len(folds) == 12 == len({r["tile"] for r in folds}) and all(r["held_out"] == (r["fold"] == 0) for r in folds)
    held = {r["tile"] for r in folds if r["held_out"]}
    pred = rows_of(spark, "rf_train_predict")
    assert {r["vec_id"] % 12 for r in pred} == held and len(pred) == sum(r["n"] for r in folds if r["held_out"])
    assert all(0 <= r["p"] <= 1 and 0 <= r["pred"] <= 9 for r in pred)
    weights = [r["importance"] for r in rows_of(spark, "rf_importance_by_date")]
    assert len(weights) == 64 and abs(sum(weights) - 1) < 1e-6 and min(weights) >= 0


def test_search(spark):
    got = rows_of(spark, "rf_group_cv_search")
    assert [r["place"] for r in got] == [0, 1, 2] and all(0 <= r["macro_f1"] <= 1 for r in got)
    whole = [r["macro_f1"] for r in got if not r["pruned"]]
    assert whole == sorted(whole, reverse=True)


def test_gappy_smoothing(spark):
    from terracurve.functions.curve import smoothed
    from terracurve.sources.adapters import ts_arrays

    got = {(r["entity"], r["k"]): r["value"] for r in rows_of(spark, "whittaker_gappy")}
    curves = {r["entity"]: [np.nan if x is None else x for x in r["curve"]] for r in ts_arrays(spark, str(DATA)).collect()}
    for entity, y in curves.items():
        z = smoothed(np.array([y]))[0]
        for k, v in enumerate(z, 1):
            assert (entity, k) not in got if np.isnan(v) else got[entity, k] == pytest.approx(v, abs=1e-5)


def test_pilot_and_resumable_write(spark):
    split = rows_of(spark, "pilot_batch_split")
    chosen = {(r["i"], r["j"]) for r in rows_of(spark, "greedy_separated")}
    assert not split or ({(r["i"], r["j"]) for r in split} == chosen and sum(r["batch"] == "pilot" for r in split) == 6)
    n = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    assert [tuple(r) for r in rows_of(spark, "resumable_write")] == [(1, n // 2), (2, n - n // 2), (3, 0)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
