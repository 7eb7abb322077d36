"""Helpers shared by the training-data operators.

Tables that are used more than once are written under the folder the cluster
names in ``spark.checkpoint.dir`` and read again: lineage ends there, a lost
executor costs only the tasks it ran, and every later join sees plain scans
whose skewed partitions the adaptive planner may split.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows and bytes (of the rows as text) up to which a side that was counted may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20
#: Number of slices that a group's rows are dealt into for a running total.
SLICES = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote; frames that read them can't be used any more."""
    _delete(spark, own_dir(spark))
    _MADE.clear()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of the tables that ``written`` has made and ``settled`` may delete.
_MADE: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of ``make()`` written; the tables that were written on the way to them are deleted."""
    begun = len(_MADE)
    out = written(make(), name)
    for path in _MADE[begun:-1]:
        _delete(spark, path)
    del _MADE[begun:-1]
    return out


def boxed(docs: DataFrame, *cols) -> DataFrame:
    """``docs`` as one column ``_row`` beside ``cols``, so that no name of theirs meets one of an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *cols)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``limit`` rows of ``BROADCAST_BYTES`` in all; reads at most one row more."""
    seen = df.limit(limit + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return seen[0] <= limit and (seen[1] or 0) <= BROADCAST_BYTES


def beside(df: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join, with ``small`` broadcast if a count shows that it is small, else shuffled."""
    return df.join(F.broadcast(small) if small_enough(small) else small, on, how)


#: Bits of a sieve of keys; its size doesn't depend on the input. Where more keys fill it up, it lets more rows pass.
SIEVE_BITS = 24


def _sieve_place(key: Column) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(key), F.lit(2**SIEVE_BITS))
    return F.shiftright(h, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))


def sieve(rows: DataFrame, key: Column, **marks: Column) -> DataFrame:
    """Bitmaps of the hashes of ``key``, one for each of ``marks`` over the rows where it is true: 2**18 rows at most."""
    word, bit = _sieve_place(key)
    return rows.groupBy(word.alias("_word")).agg(*(F.bit_or(F.when(m, bit).otherwise(0)).alias(f"_bits_{name}") for name, m in marks.items()))


def sieved(df: DataFrame, bits: DataFrame, key: Column, *names: str) -> DataFrame:
    """``df`` with a boolean for each name: false if ``key`` certainly isn't among the keys so marked. ``bits`` comes from ``sieve`` and is broadcast."""
    word, bit = _sieve_place(key)
    met = df.join(F.broadcast(bits), word == F.col("_word"), "left")
    return met.select(*df.columns, *((F.coalesce(F.col(f"_bits_{n}"), F.lit(0)).bitwiseAND(bit) != 0).alias(n) for n in names))


def words(text: Column) -> Column:
    """The words of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


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


def shuffle_key(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """32 hex digits that order rows at random, the same on every run and engine. Rows without id are told apart by their text."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), own))
