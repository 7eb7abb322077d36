"""Class profiles, distances to them, and label audits built on distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curve import let, mean_abs
from .graph import cut_lineage
from .running import quantiles, running_total, value_bin


def long_curves(df: DataFrame, *keep: str, curve: str = "curve") -> DataFrame:
    """``keep``, pos (from 0), x."""
    return df.select(*keep, F.posexplode(curve).alias("pos", "x"))


def median_profiles(curves: DataFrame, label: str = "label", curve: str = "curve") -> DataFrame:
    """label, profile: the exact median of each place over a class's curves."""
    each = quantiles(long_curves(curves, label, curve=curve), [label, "pos"], [0.5])
    by = each.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("q0").alias("m")))).alias("p"))
    return by.select(label, F.transform("p", lambda s: s["m"]).alias("profile"))


def profile_distances(curves: DataFrame, profiles: DataFrame, label: str = "label") -> DataFrame:
    """``curves`` with dists: (cls, d) for each profile, by class. There is one profile a class, so all of them travel as one row."""
    one = profiles.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("cls"), "profile"))).alias("_p"))
    met = curves.join(F.broadcast(one), F.lit(True))
    return met.withColumn("dists", _distances()).drop("_p")


def _distances():
    """(cls, d) of each profile in ``_p``."""
    return let(F.col("curve"), lambda c: F.transform("_p", lambda p: F.struct(p["cls"].alias("cls"), mean_abs(c, p["profile"]).alias("d"))))


def nearest(dists: DataFrame) -> DataFrame:
    """Adds nearest, distance and margin (second distance minus first); ties go to the smaller class."""
    by = F.array_sort(F.transform("dists", lambda s: F.struct(s["d"].alias("d"), s["cls"].alias("cls"))))
    df = dists.withColumn("_s", by)
    return df.withColumn("nearest", F.get("_s", F.lit(0))["cls"]).withColumn("distance", F.get("_s", F.lit(0))["d"]).withColumn("margin", F.get("_s", F.lit(1))["d"] - F.get("_s", F.lit(0))["d"]).drop("_s")


def scores(curves: DataFrame, sharpness: float, profiles: DataFrame | None = None) -> DataFrame:
    """``curves`` with dists, sharpness, best, pred and conf: the class of the softmax of -sharpness * distance, and its probability.

    One pass over the distances keeps the least one, its class (the smaller one
    of equals) and the sum of exponentials relative to it.
    """
    return softmax(profile_distances(curves, median_profiles(curves) if profiles is None else profiles), sharpness)


def softmax(df: DataFrame, sharpness: float) -> DataFrame:
    """``scores`` of a frame that has its dists."""
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(None).cast("int").alias("cls"), F.lit(0.0).alias("s"))

    def step(a, x):
        least = F.least(a["d"], x["d"])
        grown = a["s"] * F.exp(-sharpness * (a["d"] - least)) + F.exp(-sharpness * (x["d"] - least))
        return F.struct(least.alias("d"), F.when(x["d"] < a["d"], x["cls"]).otherwise(a["cls"]).alias("cls"), grown.alias("s"))

    df = df.withColumn("best", F.aggregate("dists", start, step)).withColumn("sharpness", F.lit(sharpness))
    return df.withColumn("pred", F.col("best.cls")).withColumn("conf", 1 / F.col("best.s"))


def prob_of(cls: int):
    """Probability of one class, from the columns that ``scores`` adds."""
    d = F.get(F.filter("dists", lambda s: s["cls"] == cls), F.lit(0))["d"]
    return F.exp(-F.col("sharpness") * (d - F.col("best.d"))) / F.col("best.s")


#: Curves of either side that meet in one task.
BLOCK = 2048


def _nearest_pairs(pos: pd.DataFrame, neg: pd.DataFrame, radius: float) -> pd.DataFrame:
    """For each curve of one side its nearest of the other, the smaller key of equals, if nearer than ``radius``."""
    out = []
    if len(pos) and len(neg):
        pos, neg = pos.sort_values("k"), neg.sort_values("k")
        x, y = np.stack(pos["curve"].to_list()), np.stack(neg["curve"].to_list())
        gaps = np.stack([np.abs(y - row).mean(axis=1) for row in x])
        for one, other, d in ((pos, neg, gaps), (neg, pos, gaps.T)):
            best = d.argmin(axis=1)
            gap = d[np.arange(len(d)), best]
            near = np.flatnonzero(gap < radius)
            out.append(pd.DataFrame({"a": one["k"].to_numpy()[near], "label_a": one["label"].to_numpy()[near], "b": other["k"].to_numpy()[best[near]], "label_b": other["label"].to_numpy()[best[near]], "gap": gap[near]}))
    columns = ["a", "label_a", "b", "label_b", "gap"]
    return pd.concat(out) if out else pd.DataFrame(columns=columns)


def contradictions(curves: DataFrame, positive, radius: float, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Each curve's nearest curve of the opposite binary label, if nearer than ``radius``.

    The distance of two curves is at least that of their means, and at least that of any of their sums with fixed
    signs, over the number of places: here of the first half less the second one. So curves meet
    only in buckets of both, as wide as the radius, and the eight around. Each
    bucket is cut into as many blocks of either side as it needs itself; a task
    compares two blocks as matrices, which built-in array functions do some fifty
    times slower.
    """
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    n = F.size("curve")
    half = F.floor(n / 2).cast("int")
    first, second = total(F.slice("curve", F.lit(1), half)), total(F.slice("curve", half + 1, n - half))
    at = lambda v: F.floor(v / n / radius)
    df = curves.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("label"), "curve", positive.alias("pos"), at(first + second).alias("bucket"), at(first - second).alias("turn"))
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    a = df.where("pos").withColumn("bucket", around("bucket")).withColumn("turn", around("turn"))
    b = df.where("not pos")
    place = ["bucket", "turn"]
    cut = lambda side, n: side.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
    blocks = cut(a, "n_pos").join(cut(b, "n_neg"), place)
    own = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(blocks, place).withColumn("i", own("n_pos")).withColumn("j", each("n_neg"))
    b = b.join(blocks, place).withColumn("j", own("n_neg")).withColumn("i", each("n_pos"))
    cols = [F.col(c).alias(c) for c in (*place, "i", "j", "k", "label", "curve")]
    keys = [*place, "i", "j"]
    met = a.select(*cols).groupBy(*keys).cogroup(b.select(*cols).groupBy(*keys)).applyInPandas(lambda x, y: _nearest_pairs(x, y, radius), "a long, label_a int, b long, label_b int, gap double")
    best = met.groupBy("a", "label_a").agg(F.min(F.struct("gap", "b", "label_b")).alias("m"))
    return best.select("a", "label_a", F.col("m.b").alias("b"), F.col("m.label_b").alias("label_b"), F.col("m.gap").alias("gap"))


def drop_near(curves: DataFrame, profiles: DataFrame, positive: int) -> DataFrame:
    """Rows whose nearest profile isn't that of ``positive``; all rows if there is no such profile."""
    if profiles.where(F.col("label") == positive).isEmpty():
        return curves
    return nearest(profile_distances(curves, profiles)).where(F.col("nearest") != positive).select(*curves.columns)


#: Slices of the ranks of a class and place, each of which is one task's work.
RANK_SLICES = 256


def medians_without(curves: DataFrame, group: str) -> DataFrame:
    """held, label, profile: for each group and each class in it, the class's exact medians over the rows of all other groups; null if there are none.

    Values are ranked once, within their class and place and within the group too. The t-th value of the others has the rank t
    plus the number of the group's own values that have at most t others before them, so no group's rest is ever formed.
    """
    each = curves.select(F.col(group).alias("held"), "label", F.posexplode("curve").alias("pos", "x")).where("x is not null and held is not null")
    counted = cut_lineage(each.groupBy("label", "pos", "held", "x").agg(F.count(F.lit(1)).alias("c")).withColumn("bin", value_bin(F.col("x"))))
    ranked = running_total(counted, ["label", "pos"], "bin", ["x", "held"], F.col("c"), "before")
    ranked = cut_lineage(running_total(ranked, ["label", "pos", "held"], "bin", ["x"], F.col("c"), "own"))
    n = ranked.groupBy("label", "pos").agg(F.sum("c").alias("n"))
    rest = ranked.groupBy("label", "pos", "held").agg(F.sum("c").alias("own_n")).join(n, ["label", "pos"])
    rest = rest.select("label", "pos", "held", F.expr("n - own_n").alias("m"), F.explode(F.expr("array((n - own_n - 1) div 2, (n - own_n) div 2)")).alias("t"))
    passed = F.sum(F.when(F.col("before") - F.col("own") <= F.col("t"), F.col("c")).otherwise(0))
    # Both ranks of a pair may be one and the same; then they count once, which gives the same mean.
    wanted = cut_lineage(ranked.join(rest.where("m > 0").distinct(), ["label", "pos", "held"]).groupBy("label", "pos", "held", "t").agg(passed.alias("j")).select("label", "pos", "held", F.expr("t + j").alias("at")))
    # A value stands for the ranks from before on, c of them. Ranks lie in slices of a class and place, and a value in every slice that its ranks reach.
    span = wanted.groupBy("label", "pos").agg(F.min("at").alias("first"), F.max("at").alias("last")).join(n, ["label", "pos"])
    part = lambda at: F.expr(f"({at}) * {RANK_SLICES} div n")
    near = ranked.join(span, ["label", "pos"]).where("before <= last and before + c > first").withColumn("slice", F.explode(F.sequence(part("before"), part("before + c - 1"))))
    events = near.select("label", "pos", "slice", F.col("before").alias("at"), F.lit(0).alias("kind"), "x", F.lit(None).cast(curves.schema[group].dataType).alias("held"))
    asked = wanted.join(n, ["label", "pos"]).select("label", "pos", part("at").alias("slice"), "at", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("x"), "held")
    events = events.unionByName(asked)
    value = F.last("x", True).over(Window.partitionBy("label", "pos", "slice").orderBy("at", "kind"))
    medians = events.withColumn("v", value).where("kind = 1").groupBy("held", "label", "pos").agg(F.avg("v").alias("m"))
    known = medians.groupBy("held", "label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("p")).select("held", "label", F.transform("p", lambda s: s["m"]).alias("profile"))
    gone = rest.where("m = 0").select("held", "label").distinct().select("held", "label", F.lit(None).cast("array<double>").alias("profile"))
    return known.unionByName(gone)


def leave_one_out(curves: DataFrame, group: str, positive: int) -> DataFrame:
    """For each group, agreement of its labels with the nearest profile of all other groups.

    Rows: group, rows, agreement_pct, positive_missed, negative_taken. A group
    without which only one class is left is skipped. Classes that a group lacks
    keep their profile over all rows.
    """
    profile = lambda label: F.sort_array(F.collect_list(F.struct(F.col(label).alias("cls"), "profile")))
    every = median_profiles(curves).agg(profile("label").alias("_all"))  # one row, one profile a class
    changed = medians_without(curves, group).groupBy("held").agg(profile("label").alias("_own"))
    other = lambda p: F.filter("_own", lambda o: o["cls"] == p["cls"])
    mine = lambda p: F.when(F.size(other(p)) > 0, F.get(other(p), F.lit(0))["profile"]).otherwise(p["profile"])
    per = changed.join(F.broadcast(every), F.lit(True))
    per = per.select("held", F.filter(F.transform("_all", lambda p: F.struct(p["cls"].alias("cls"), mine(p).alias("profile"))), lambda p: p["profile"].isNotNull()).alias("_p"))
    met = curves.join(per.where(F.size("_p") > 1), F.col(group) == F.col("held")).withColumn("dists", _distances())
    near = nearest(met)
    return near.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), (100 * F.avg((F.col("nearest") == F.col("label")).cast("double"))).alias("agreement_pct"),
        F.count_if((F.col("label") == positive) & (F.col("nearest") != positive)).alias("positive_missed"),
        F.count_if((F.col("label") != positive) & (F.col("nearest") == positive)).alias("negative_taken"),
    )


def shares(df: DataFrame, row: str, col: str, values: list, names: list[str]) -> DataFrame:
    """Crosstab in hundredths of each row's total, with a fixed order of columns and 0 where there is nothing."""
    counts = df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in values), F.lit(0))
    return counts.select(row, *((100.0 * F.coalesce(F.col(f"`{v}`"), F.lit(0)) / total).alias(n) for v, n in zip(values, names, strict=True)))
