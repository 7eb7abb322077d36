"""Cell scores, and the greedy choice of cells.

The choice looks at each candidate in the light of those taken before, so it
runs on the driver; its input is a shortlist with a stated limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_ACRES, LEAST_COTTON, SHORTLIST = 400.0, 60.0, 60
WANT, SOUTH_MIN, SOUTH_MAX = 16, 5, 8
PILOT, PILOT_SOUTH, REQUIRED = 6, (2, 3), ("cotton", "rice", "sugarcane", "orchard")
SOUTH_LAT = 28.5


def saturated(acres: Column) -> Column:
    return F.sqrt(F.least(F.greatest(acres, F.lit(0.0)), F.lit(TARGET_ACRES)) / TARGET_ACRES)


def score(classes: Iterable[str], cotton: str = "cotton") -> Column:
    """1.5 for cotton and 1 for each other class, each concave and saturated."""
    return sum((saturated(F.col(c)) for c in classes if c != cotton), 1.5 * saturated(F.col(cotton)))


def negative_score(classes: Iterable[str] = ("rice", "fall_maize")) -> Column:
    return sum((saturated(F.col(c)) for c in classes), F.lit(0.0))


def shortlist(cells: DataFrame, value: Column, n: int = SHORTLIST) -> DataFrame:
    return cells.withColumn("score", value).orderBy(F.col("score").desc(), "i", "j").limit(n)


def two_lists(cells: DataFrame, value: str, region: Column, n: int, m: int) -> DataFrame:
    """The top n overall, then those of the top m of a region that aren't among them; place gives the order.

    Both ranks come from lists that are cut before they are ranked.
    """
    order = [F.col(value).desc(), F.col("i"), F.col("j")]
    top = cells.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    south = cells.where(region).orderBy(*order).limit(m).withColumn("place", n + F.row_number().over(Window.orderBy(*order)))
    return top.unionByName(south.join(top.select("i", "j"), ["i", "j"], "left_anti"))


def first_region_acres(points: DataFrame, *keys: str) -> DataFrame:
    """keys, first_acres, all_acres. ``points``: keys, id, rank of a region that holds the point, acres; a point in several
    regions has several rows. first_acres counts a cell in the first region it appears in; all_acres counts each point once."""
    own = points.groupBy(*keys, "id").agg(F.min("rank").alias("rank"), F.min_by("acres", "rank").alias("acres"))
    by = own.groupBy(*keys, "rank").agg(F.sum("acres").alias("_a"))  # one row a region
    return by.groupBy(*keys).agg(F.min_by("_a", "rank").alias("first_acres"), F.sum("_a").alias("all_acres"))


@dataclass(frozen=True)
class Rule:
    """One pass over the candidates: which ones it looks at, how many cells there may be after it, how far apart, and how many southern ones at most."""

    only: Callable[[dict], bool]
    total: int
    distance: int
    southern: int = 1 << 30

    def admits(self, cell: dict, chosen: tuple[dict, ...]) -> bool:
        room = len(chosen) < self.total and self.only(cell) and not (cell["south"] and sum(c["south"] for c in chosen) >= self.southern)
        return room and not any(abs(cell["i"] - c["i"]) < self.distance and abs(cell["j"] - c["j"]) < self.distance for c in chosen)


def chosen_by(rules: Iterable[Rule], cells: list[dict]) -> list[dict]:
    """Folds the passes, one rule after the other over all cells in their order, into one choice."""
    passes = ((rule, cell) for rule in rules for cell in cells)
    return list(reduce(lambda chosen, step: (*chosen, step[1]) if step[0].admits(step[1], chosen) else chosen, passes, ()))


def _anywhere(cell: dict) -> bool:
    return True


def _south(cell: dict) -> bool:
    return cell["south"]


#: Southern cells up to their least number, then all cells up to WANT; the distance gives way from 3 to 1 in both.
CELL_RULES = [Rule(_south, SOUTH_MIN, d) for d in (3, 2, 1)] + [Rule(_anywhere, WANT, d, SOUTH_MAX) for d in (3, 2, 1)]


def _picked(cells: Column, pilot: Column) -> Column:
    """``pilot`` with the best of the other ``cells``: first those that keep the south within its limits, then by required classes that
    the pilot lacks, by score, and by place."""
    south = F.size(F.filter(pilot, lambda c: c["south"]))
    only_north, only_south = south >= PILOT_SOUTH[1], PILOT_SOUTH[0] - south >= PILOT - F.size(pilot)
    covered = F.flatten(F.transform(pilot, lambda c: c["has"]))
    fits = lambda c: F.when(only_north, ~c["south"]).when(only_south, c["south"]).otherwise(F.lit(True))
    ranked = F.transform(F.array_except(cells, pilot), lambda c: F.struct(fits(c).alias("fits"), F.size(F.array_except(c["has"], covered)).alias("new"), c["score"].alias("score"), (-c["place"]).alias("before"), c.alias("cell")))
    return F.concat(pilot, F.array(F.array_max(ranked)["cell"]))


def _covering(cells: Column, pilot: Column, name: Column) -> Column:
    """``pilot`` with a class that it lacks and another cell has: the best such cell comes in for the pilot's lowest score."""
    has = lambda c: F.array_contains(c["has"], name)
    others = F.filter(F.array_except(cells, pilot), has)
    best = F.array_max(F.transform(others, lambda c: F.struct(c["score"].alias("score"), (-c["place"]).alias("before"), c.alias("cell"))))["cell"]
    lowest = F.array_min(F.transform(pilot, lambda c: F.struct(c["score"].alias("score"), c["place"].alias("place"))))["place"]
    lacks = ~F.exists(pilot, has) & (F.size(others) > 0)
    return F.when(lacks, F.concat(F.filter(pilot, lambda c: c["place"] != lowest), F.array(best))).otherwise(pilot)


def pilot_and_rest(selected: DataFrame, classes: Iterable[str] = REQUIRED) -> DataFrame:
    """``selected`` (place, i, j, score, south, acres of ``classes``; 16 rows or so) with batch: pilot or extension; no row if there are too few for a pilot.

    Both steps fold over one array of the cells: the pilot's places one after the other, then the required classes.
    """
    has = F.filter(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in classes)), lambda c: c.isNotNull())
    cell = F.struct("place", "score", "south", has.alias("has"))
    row = selected.agg(F.sort_array(F.collect_list(cell)).alias("cells")).where(F.size("cells") >= PILOT)
    row = row.withColumn("pilot", F.aggregate(F.sequence(F.lit(1), F.lit(PILOT)), F.slice("cells", 1, 0), lambda pilot, _: _picked(F.col("cells"), pilot)))
    row = row.withColumn("pilot", F.aggregate(F.array(*map(F.lit, classes)), F.col("pilot"), lambda pilot, name: _covering(F.col("cells"), pilot, name)))
    met = selected.join(F.broadcast(row.select(F.transform("pilot", lambda c: c["place"]).alias("_pilot"))), F.lit(True))
    return met.withColumn("batch", F.when(F.array_contains("_pilot", F.col("place")), "pilot").otherwise("extension")).drop("_pilot")


def negative_rules(want: int = 4) -> list[Rule]:
    """One northern and one southern cell, then any, ever nearer to each other."""
    return [Rule(lambda c: not c["south"], 1, 5), Rule(_south, 2, 5)] + [Rule(_anywhere, want, d) for d in (5, 3, 2)]
