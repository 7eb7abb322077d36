"""Random forests on curves: weights, group hold-out, search, importance, card."""

from __future__ import annotations

import math
import random
import re
from statistics import mean, median, pstdev

from pyspark import __version__
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ContractError, require_dates
from . import evaluate
from .graph import cut_lineage

#: Spark's trees are at most 30 deep.
MAX_DEPTH = 30
DEFAULTS = {"trees": 250, "depth": 30, "leaf": 1, "features": "sqrt"}


def features(df: DataFrame, curve: str = "curve") -> DataFrame:
    return df.withColumn("features", array_to_vector(curve))


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight n / (k * n_c), so that every class weighs the same."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))  # one row
    w = counts.join(F.broadcast(total), F.lit(True)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return df.join(F.broadcast(w), label)  # one row a class


def fit(df: DataFrame, trees: int = 250, depth: int = 30, leaf: int = 1, features: str = "sqrt", seed: int = 42) -> RandomForestClassificationModel:
    """``df``: features, label (an int from 0), weight."""
    rf = RandomForestClassifier(numTrees=trees, maxDepth=min(depth, MAX_DEPTH), minInstancesPerNode=leaf, featureSubsetStrategy=features, weightCol="weight", seed=seed)
    return rf.fit(df)


def predict(model, df: DataFrame, positive: int = 1) -> DataFrame:
    """Adds pred (int) and p, the probability of ``positive``; a vector's place is the class code."""
    return model.transform(df).withColumn("pred", F.col("prediction").cast("int")).withColumn("p", F.get(vector_to_array("probability"), F.lit(positive)))


def group_counts(df: DataFrame, group: str, label: str = "label") -> dict:
    """Counts by group and class: the one table that the driver needs, a row for each pair."""
    out: dict = {}
    for r in df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(r[group], {})[r[label]] = r["n"]
    return out


def fold_number(counts: dict, share: float) -> int:
    smallest = min(sum(c.get(k, 0) for c in counts.values()) for k in set().union(*counts.values()))
    return max(2, min(round(1 / share), len(counts), smallest))


def assign_folds(counts: dict, folds: int, seed: int = 42) -> dict:
    """Group to fold, whole groups only. Groups, the most uneven ones first, go where the spread of each class over the
    folds stays least; ties go to the fold with fewer rows."""
    classes = sorted(set().union(*counts.values()))
    total = {k: sum(c.get(k, 0) for c in counts.values()) for k in classes}
    order = sorted(counts, key=str)
    random.Random(seed).shuffle(order)
    order.sort(key=lambda g: -pstdev([counts[g].get(k, 0) for k in classes]))
    held = [dict.fromkeys(classes, 0) for _ in range(folds)]
    out = {}
    for g in order:
        def spread(f, g=g):
            shares = [[(held[i][k] + (counts[g].get(k, 0) if i == f else 0)) / total[k] for i in range(folds)] for k in classes]
            return mean(map(pstdev, shares)), sum(held[f].values())

        f = min(range(folds), key=spread)
        out[g] = f
        for k, n in counts[g].items():
            held[f][k] += n
    return out


#: Groups up to which their table of folds is broadcast; rows then keep their order, and forests of one seed are the same again.
BROADCAST_GROUPS = 10_000


def with_folds(df: DataFrame, group: str, fold: dict) -> DataFrame:
    """``df`` with the fold of its group, by a join; rows of other groups are left out."""
    kind = next(t for n, t in df.dtypes if n == group)
    table = df.sparkSession.createDataFrame(list(fold.items()), f"`{group}` {kind}, fold int")
    return df.join(F.broadcast(table) if len(fold) <= BROADCAST_GROUPS else table, group)


def hold_out(df: DataFrame, group: str, share: float = 0.25, seed: int = 42, label: str = "label") -> tuple[DataFrame, DataFrame, list]:
    """Training and held-out rows with no group in common, and the classes that the held-out rows lack."""
    counts = group_counts(df, group, label)
    if len(counts) < 2:
        raise ValueError("at least two groups are needed")
    fold = assign_folds(counts, fold_number(counts, share), seed)
    here = set().union(*(counts[g] for g, f in fold.items() if f == 0))
    if len(here) < 2:
        raise ValueError("the held-out groups have fewer than two classes")
    rows = with_folds(df, group, fold)
    return rows.where("fold <> 0").drop("fold"), rows.where("fold = 0").drop("fold"), sorted(set().union(*counts.values()) - here)


def macro_f1(pred: DataFrame) -> float:
    """Over the classes that occur among the true labels."""
    return evaluate.summary(evaluate.report(evaluate.confusion(pred))).first()["macro_f1"] or 0.0


#: Trials that are drawn at random before densities are used, values that are drawn from the good density at each, and the most trials that count as good.
START, DRAWS, GOOD = 10, 24, 25
#: Times that values are drawn again if they were tried before: folds and seeds are fixed, so they would score the same.
AGAIN = 20


def _density(values: list, seen: list) -> list[float]:
    """Weight of each value: a uniform prior of one trial, and a bump around each of ``seen``; numbers are near each other by rank, other values aren't."""
    if not all(isinstance(v, (int, float)) for v in values):
        return [1 / len(values) + seen.count(v) for v in values]
    places = sorted(values.index(v) for v in seen)
    weights = [1 / len(values)] * len(values)
    for n, p in enumerate(places):
        # As wide as the gap to the farther neighbour, but no narrower than the range over the number of trials.
        gaps = [places[n] - places[n - 1] if n else p, places[n + 1] - p if n + 1 < len(places) else len(values) - 1 - p]
        width = max(*gaps, (len(values) - 1) / min(100, len(places) + 1), 0.5)
        bump = [math.exp(-(((k - p) / width) ** 2) / 2) for k in range(len(values))]
        total = sum(bump)
        weights = [w + b / total for w, b in zip(weights, bump, strict=True)]
    return weights


def suggested(space: dict[str, list], tried: list[tuple[dict, float]], rng: random.Random) -> dict:
    """Values for the next trial by tree-structured Parzen estimators. ``tried``: values and score, higher ones better.

    The best fifth of the trials makes the good density of a parameter and the rest the bad one; of some values drawn
    from the good one, that with the largest ratio of the two is taken, which is where the expected improvement is largest.
    """
    if len(tried) < START:
        return {k: rng.choice(list(v)) for k, v in space.items()}
    order = [p for p, _ in sorted(tried, key=lambda t: -t[1])]
    cut = min(math.ceil(len(order) / 5), GOOD)
    values = {name: list(choices) for name, choices in space.items()}
    both = {name: [_density(own, [p[name] for p in part]) for part in (order[:cut], order[cut:])] for name, own in values.items()}
    for _ in range(AGAIN):
        drawn = {name: rng.choices(range(len(own)), both[name][0], k=DRAWS) for name, own in values.items()}
        out = {name: values[name][max(ks, key=lambda k, d=both[name]: d[0][k] / d[1][k])] for name, ks in drawn.items()}
        if out not in order:
            break
    return out


#: Values of the parameters that a search tries; splits of fewer rows than a number aren't a parameter of Spark's trees.
SPACE = {"trees": range(150, 501, 50), "depth": range(8, MAX_DEPTH + 1), "leaf": range(1, 13), "features": ["sqrt", "log2", "0.3"]}


def search(df: DataFrame, group: str, trials: int, folds: int = 3, seed: int = 42, space: dict | None = None, sampler: str = "tpe") -> list[dict]:
    """Search with fixed folds, by Parzen estimators or (``sampler="random"``) at random. A trial ends early if, after its second
    fold, its running mean lies below the median of earlier trials at that fold. No trials: the defaults, with no value.

    Rows are computed once, with their folds.
    """
    if trials <= 0:
        return [DEFAULTS | {"value": None, "pruned": False}]
    space = space or SPACE
    counts = group_counts(df, group)
    fold = assign_folds(counts, max(2, min(folds, len(counts))), seed)
    rows = cut_lineage(with_folds(df.select("features", "label", group), group, fold))
    names = sorted(set(fold.values()))
    rng, found, at_step = random.Random(seed), [], {}
    for _ in range(trials):
        tried = [({k: t[k] for k in space}, t["value"]) for t in found] if sampler == "tpe" else []
        params = suggested(space, tried, rng)
        values, pruned = [], False
        for step, f in enumerate(names):
            model = fit(balanced(rows.where(F.col("fold") != f)), **params, seed=seed)
            values.append(macro_f1(predict(model, rows.where(F.col("fold") == f))))
            seen = at_step.setdefault(step, [])
            pruned = step >= 1 and bool(seen) and step < len(names) - 1 and mean(values) < median(seen)
            seen.append(mean(values))
            if pruned:
                break
        found.append(params | {"value": mean(values), "pruned": pruned})
    return sorted(found, key=lambda t: (t["pruned"], -t["value"]))


def k_fold(df: DataFrame, key: Column, folds: int = 3, seed: int = 42, **params) -> list[float]:
    """Macro F1 of each fold; rows are dealt to the folds in the order of a seeded hash of ``key``."""
    df = cut_lineage(df)
    own = F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(folds))
    return [macro_f1(predict(fit(balanced(df.where(own != f)), seed=seed, **params), df.where(own == f))) for f in range(folds)]


def save(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def check_card(columns: list[str], codes: dict[str, int], card: dict) -> list[str]:
    """The feature columns that a model of this card reads, in its order; refuses a table whose dates are missing, out of order or not
    the card's, and class codes that mean something else than they did."""
    require_dates(columns, card["dates"], "the table")
    dated = [c for c in columns if re.fullmatch(r"\d{4}-\d\d-\d\d", c)]
    if dated != card["dates"]:
        raise ContractError(f"the table has {len(dated)} dates, the model was made for {len(card['dates'])}")
    changed = sorted(k for k in card["codes"].keys() | codes.keys() if card["codes"].get(k) != codes.get(k))
    if changed:
        raise ContractError(f"codes differ from the model's: {changed}")
    return card["dates"]


def importance(spark, model, dates: list) -> DataFrame:
    """place, date, importance: one row a date."""
    rows = [(i, d, float(x)) for i, (d, x) in enumerate(zip(dates, model.featureImportances.toArray(), strict=True))]
    return spark.createDataFrame(rows, "place int, date string, importance double")


def card(df: DataFrame, dates: list[str], codes: dict[str, int], params: dict, source: str) -> dict:
    """What a later run needs to know about a model, the real source of its rows included."""
    counts = group_counts(df, "tile")
    rows: dict = {}
    for c in counts.values():
        for k, n in c.items():
            rows[k] = rows.get(k, 0) + n
    return {"dates": dates, "codes": codes, "tiles": sorted(map(str, counts)), "rows_per_class": {str(k): n for k, n in sorted(rows.items())}, "params": params, "source": source, "spark": __version__}
