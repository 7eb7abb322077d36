"""Queries on learning: hold-out, forests, search, importance, guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as ml
from ..operators import sampling
from ..schema import DATES, ContractError, check_labelled
from ..sources.adapters import vec_curves
from .registry import query


def _set(spark, sf_dir):
    return ml.features(vec_curves(spark, sf_dir).withColumn("label", F.col("label").cast("int")))


@query()
def group_holdout_assignment(spark, sf_dir):
    counts = ml.group_counts(vec_curves(spark, sf_dir), "tile")
    fold = ml.assign_folds(counts, ml.fold_number(counts, 0.25))
    rows = [(t, f, sum(counts[t].values()), f == 0) for t, f in sorted(fold.items())]
    return spark.createDataFrame(rows, "tile long, fold int, n long, held_out boolean")


def _trained(spark, sf_dir):
    train, test, _ = ml.hold_out(_set(spark, sf_dir), "tile")
    return ml.fit(ml.balanced(train), trees=20, depth=10), test


@query()
def rf_train_predict(spark, sf_dir):
    model, test = _trained(spark, sf_dir)
    return ml.predict(model, test).select("vec_id", "label", "pred", F.round("p", 6).alias("p"))


@query()
def rf_group_cv_search(spark, sf_dir):
    space = {"trees": [5, 10], "depth": [4, 6], "leaf": [1, 4], "features": ["sqrt"]}
    rows = [(n, t["trees"], t["depth"], t["leaf"], t["features"], t["value"], t["pruned"]) for n, t in enumerate(ml.search(_set(spark, sf_dir), "tile", 3, 3, space=space))]
    return spark.createDataFrame(rows, "place int, trees int, depth int, leaf int, features string, macro_f1 double, pruned boolean")


@query()
def capped_group_forest(spark, sf_dir):
    """At most 30 rows a class, whole tiles held out of these, and a forest (20 trees of depth 10) on the rest: rows of each class, and hits among the held-out ones."""
    df = sampling.cap(_set(spark, sf_dir), 30, F.col("vec_id"), 42, "label").select("vec_id", "label", "tile", "features")
    train, test, _ = ml.hold_out(df, "tile")
    pred = ml.predict(ml.fit(ml.balanced(train), trees=20, depth=10), test)
    tested = pred.groupBy("label").agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("pred") == F.col("label")).alias("hits"))
    by = df.groupBy("label").agg(F.count(F.lit(1)).alias("n_capped")).join(tested, "label", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return by.select("label", "n_capped", (F.col("n_capped") - zero("n_test")).alias("n_train"), zero("n_test").alias("n_test"), zero("hits").alias("hits"))


@query()
def rf_importance_by_date(spark, sf_dir):
    model, _ = _trained(spark, sf_dir)
    return ml.importance(spark, model, [f"step_{i:02d}" for i in range(64)])


@query()
def feature_contract_guard(spark, sf_dir):
    """What the guard says of a good table and of broken ones."""
    df = vec_curves(spark, sf_dir).where("label between 1 and 6").select("label", "tile", *(F.get("curve", F.lit(i)).alias(d) for i, d in enumerate(DATES)))
    cases = {
        "good": df,
        "reordered": df.select("label", "tile", DATES[1], DATES[0], *DATES[2:]),
        "dropped": df.drop(DATES[17]),
        "unknown_code": df.withColumn("label", F.lit(9)),
        "no_tile": df.drop("tile"),
        "not_finite": df.withColumn(DATES[3], F.lit(float("nan"))),
        "one_class": df.where("label = 1"),
        "one_tile": df.where("tile = 1"),
    }
    rows = []
    for name, case in cases.items():
        try:
            check_labelled(case)
            rows.append((name, False, ""))
        except ContractError as e:
            rows.append((name, True, str(e)))
    return spark.createDataFrame(rows, "name string, refused boolean, message string")
