"""Features stored by the blocks of a lattice, and along a curve that keeps neighbours together.

A feature is stored once for each block that its box meets, in the block's own partition. A walk names the blocks it wants in a
table; the join on the partition columns prunes the others while it runs. A feature that comes from
several blocks belongs to the one that holds its centroid, so nothing is counted twice and nothing is lost, as long as
that block is walked too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import centroid

#: Bits a coordinate has in the key of the curve.
BITS = 16


def _spread(v: Column) -> Column:
    """The bits of a number below 2**16 with a gap after each, by halving the distance they move."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = F.shiftleft(v, shift).bitwiseOR(v).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Place of (x, y) on the Z-shaped curve over a box: the bits of both, in turn."""
    last = 2**BITS - 1
    place = lambda v, lo, hi: F.coalesce(F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * (last + 1)), F.lit(0))
    part = lambda *box: F.greatest(F.least(place(*box), F.lit(last)), F.lit(0)).cast("long")
    return _spread(part(x, x0, x1)).bitwiseOR(F.shiftleft(_spread(part(y, y0, y1)), 1))


def boxed(shapes: DataFrame) -> DataFrame:
    """``shapes`` (xs, ys) with xmin, ymin, xmax, ymax."""
    return shapes.withColumns({f"{c}{m}": f(f"{c}s") for m, f in (("min", F.array_min), ("max", F.array_max)) for c in "xy"})


def write_along_curve(shapes: DataFrame, path: str, files: int | None = None, **options: str) -> None:
    """Features with their boxes, in the order of the curve through the middles of the boxes: row groups hold neighbours in
    both directions, so a window skips most of them."""
    df = boxed(shapes)
    ends = df.agg(*(F.min(c).alias(f"_{c}") for c in ("xmin", "ymin")), *(F.max(c).alias(f"_{c}") for c in ("xmax", "ymax")))  # one row
    key = morton((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, *map(F.col, ("_xmin", "_ymin", "_xmax", "_ymax")))
    df = df.join(F.broadcast(ends), F.lit(True)).withColumn("_key", key)
    df = df.repartitionByRange(files, "_key") if files else df.repartitionByRange("_key")
    df.sortWithinPartitions("_key").drop("_key", "_xmin", "_ymin", "_xmax", "_ymax").write.mode("overwrite").options(**options).parquet(path)


def stored_extent(spark: SparkSession, path: str) -> DataFrame:
    """xmin, ymin, xmax, ymax of all features from the files' footers alone: the aggregates are pushed into the reader.

    Settings of the session hold while the plan is made, so the answer, one row, is read here.
    """
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.read.parquet(path).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
        row, plan = df.first(), df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if "PushedAggregation: [MIN(xmin)" not in plan:
        raise RuntimeError("the reader didn't answer from its footers")
    return spark.createDataFrame([tuple(row)], "xmin double, ymin double, xmax double, ymax double")


def write_lattice(shapes: DataFrame, path: str, side: float) -> None:
    """Features in a partition (bi, bj) for each block of ``side`` that their box meets."""
    along = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}min") / side), F.floor(F.col(f"{c}max") / side)))
    df = boxed(shapes).withColumn("bi", along("x")).withColumn("bj", along("y"))
    df.repartition("bi", "bj").write.mode("overwrite").partitionBy("bi", "bj").parquet(path)


def walked(spark: SparkSession, path: str, blocks: DataFrame, side: float) -> DataFrame:
    """Features of the ``blocks`` (bi, bj) that own them, each once."""
    own = blocks.select(F.col("bi").cast("long").alias("_bi"), F.col("bj").cast("long").alias("_bj")).distinct()
    x, y = centroid(F.col("xs"), F.col("ys"))
    met = spark.read.parquet(path).join(own, (F.col("bi") == F.col("_bi")) & (F.col("bj") == F.col("_bj"))).drop("_bi", "_bj")
    return met.where((F.floor(x / side) == F.col("bi")) & (F.floor(y / side) == F.col("bj")))
