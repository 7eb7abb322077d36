"""Confusion, reports, sweeps over thresholds, comparison of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """truth, pred, n over the union of labels, zeros included."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("truth", "pred")).alias("x")).distinct()  # one row a class
    every = labels.select(F.col("x").alias("truth")).join(F.broadcast(labels.select(F.col("x").alias("pred"))), F.lit(True))
    return every.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def report(matrix: DataFrame) -> DataFrame:
    """cls, precision, recall, f1, support; a ratio without cases is 0."""
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    each = matrix.select("truth", "pred", "n", F.explode(F.when(F.col("truth") == F.col("pred"), F.array("truth")).otherwise(F.array("truth", "pred"))).alias("cls"))
    hit = F.sum(F.when((F.col("truth") == F.col("cls")) & (F.col("pred") == F.col("cls")), F.col("n")).otherwise(0))
    by = each.groupBy("cls").agg(hit.alias("tp"), F.sum(F.when(F.col("pred") == F.col("cls"), F.col("n")).otherwise(0)).alias("taken"), F.sum(F.when(F.col("truth") == F.col("cls"), F.col("n")).otherwise(0)).alias("support"))
    p, r = zero(F.col("tp"), F.col("taken")), zero(F.col("tp"), F.col("support"))
    by = by.withColumn("precision", p).withColumn("recall", r)
    return by.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("cls", "precision", "recall", "f1", "support", "tp")


def summary(rep: DataFrame) -> DataFrame:
    """One row: macro_f1 over classes with cases, balanced_accuracy, accuracy."""
    seen = F.col("support") > 0
    return rep.agg(F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"), (F.sum("tp") / F.sum("support")).alias("accuracy"))


def rates(df: DataFrame, prob: str, cuts: list[float], *keys: str) -> DataFrame:
    """keys, cut, pct: hundredths of rows with prob >= cut; null where no row of the keys has a prob.

    Rows are counted once, by the number of cuts they reach; a cut's count is that of all rows that reach it or a later one.
    """
    cuts = sorted(cuts)
    reached = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: F.col(prob) >= c))
    counts = df.groupBy(*keys, F.when(F.col(prob).isNotNull(), reached).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    by = counts.groupBy(*keys).agg(F.collect_list(F.struct("_r", "_n")).alias("_b"))  # one for each cut at most
    total = lambda least: F.aggregate(F.filter("_b", lambda b: b["_r"] >= least), F.lit(0).cast("long"), lambda s, b: s + b["_n"])
    each = by.select(*keys, "_b", F.posexplode(F.array(*(F.lit(c) for c in cuts))).alias("_i", "cut"))
    return each.select(*keys, "cut", (100 * (total(F.col("_i") + 1) / F.nullif(total(F.lit(0)), F.lit(0)))).alias("pct"))


CUTS = [round(0.05 + 0.025 * i, 3) for i in range(37)]


def matched_recall(df: DataFrame, prob: str, targets: list[float], positive: int, cuts: list[float] = CUTS) -> DataFrame:
    """model, target, cut, recall, mean_commission at the first cut whose recall is nearest the target. ``df``: model, label, prob."""
    by = rates(df, prob, cuts, "model", "label")
    wide = by.groupBy("model", "cut").agg(F.max(F.when(F.col("label") == positive, F.col("pct"))).alias("recall"), F.avg(F.when(F.col("label") != positive, F.col("pct"))).alias("mean_commission"))
    each = wide.select("*", F.explode(F.array(*(F.lit(float(t)) for t in targets))).alias("target"))
    best = F.min(F.struct(F.abs(F.col("recall") - F.col("target")).alias("d"), "cut", "recall", "mean_commission")).alias("b")
    return each.groupBy("model", "target").agg(best).select("model", "target", "b.cut", "b.recall", "b.mean_commission")


def compared(df: DataFrame, a: Column, b: Column, positive: int) -> DataFrame:
    """aoi (POOLED for all), label, pixels, meaning, a_pct, b_pct, delta."""
    pct = lambda x: 100 * F.avg(x.cast("double"))
    df = df.withColumn("_a", a).withColumn("_b", b)
    by = df.groupingSets([[F.col("aoi"), F.col("label")], [F.col("label")]], "aoi", "label").agg(F.count(F.lit(1)).alias("pixels"), pct(F.col("_a")).alias("a_pct"), pct(F.col("_b")).alias("b_pct"), F.grouping("aoi").alias("_all"))
    meaning = F.when(F.col("label") == positive, "recall").otherwise("commission")
    return by.select(F.when(F.col("_all") == 1, "POOLED").otherwise(F.col("aoi").cast("string")).alias("aoi"), "label", "pixels", meaning.alias("meaning"), "a_pct", "b_pct", (F.col("b_pct") - F.col("a_pct")).alias("delta"))


def histogram(df: DataFrame, value: str, bins: int, *keys: str) -> DataFrame:
    """keys, bin, n, density over [0, 1]; the last bin is closed."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    by = df.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = by.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return by.join(total, list(keys)).select(*keys, "bin", "n", (F.col("n") * float(bins) / F.col("_t")).alias("density"))
