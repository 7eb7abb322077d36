"""Running totals of groups that are larger than one task should sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: list[str], slice_by: str, order: list[str], weight: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows before this one in its group.

    Rows of a group are ordered by (slice_by, *order). Only a slice is sorted
    in one task; the totals of the slices, at most as many a group as
    ``slice_by`` has values, are added up beforehand. ``df`` is read twice.
    """
    df = df.withColumn("_w", weight.cast("long"))
    totals = df.groupBy(*group, slice_by).agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*group).orderBy(slice_by).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, slice_by])), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    on = None
    for i, c in enumerate([*group, slice_by]):
        same = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    inner = Window.partitionBy(*group, slice_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(base, on).withColumn(out, F.col("_b") + F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    return joined.drop("_w", "_b", *(f"_k{i}" for i in range(len(group) + 1)))


#: Bins of the values between a power of two and the next one, by which the values of a group are counted before any of them is sorted.
BINS = 1024


def value_bin(x: Column) -> Column:
    """Bins in the order of the values, from their leading digits, so that they are as fine for small values as for large ones. 0 is a bin of its own."""
    power = F.floor(F.log2(F.abs(x)))
    # Where the logarithm is rounded up to the next power, the second term is short by as much.
    size = (power + 1100) * BINS + F.floor(F.abs(x) / F.pow(F.lit(2.0), power) * BINS) - BINS
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("long")


def quantiles(df: DataFrame, keys: list[str], shares: list[float], x: str = "x") -> DataFrame:
    """keys, q0, q1, ...: exact quantiles of ``x``, interpolated; keys without a value are absent.

    Two passes over the rows. The first counts the values of bins, which tells the bins that the wanted ranks fall into; the
    second counts the distinct values of those bins only. No task holds a group's values, however many it has.
    """
    values = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x")).withColumn("_b", value_bin(F.col("_x")))
    own = Window.partitionBy(*keys)
    sizes = values.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    sizes = sizes.withColumn("_end", F.sum("_c").over(own.orderBy("_b"))).withColumn("_n", F.sum("_c").over(own))
    place = [(F.col("_n") - 1) * F.lit(float(q)) for q in shares]
    ranks = [f(p) for p in place for f in (F.floor, F.ceil)]
    here = lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end"))
    held = sizes.where(F.exists(F.array(*ranks), here))
    held = held.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_hb"), (F.col("_end") - F.col("_c")).alias("_start"), "_n")
    on = F.col("_b") == F.col("_hb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    few = values.join(held, on).groupBy(*keys, "_b", "_start", "_n", "_x").agg(F.count(F.lit(1)).alias("_c"))
    few = few.withColumn("_to", F.col("_start") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_x")))
    at = lambda r: F.max(F.when((r >= F.col("_to") - F.col("_c")) & (r < F.col("_to")), F.col("_x")))
    found = few.groupBy(*keys, "_n").agg(*(at(r).alias(f"_r{i}") for i, r in enumerate(ranks)))
    between = lambda i, p: (F.col(f"_r{2 * i}") + (F.col(f"_r{2 * i + 1}") - F.col(f"_r{2 * i}")) * (p - F.floor(p))).alias(f"q{i}")
    return found.select(*keys, *(between(i, p) for i, p in enumerate(place)))
