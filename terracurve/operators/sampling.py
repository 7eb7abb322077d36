"""Seeded sampling without replacement, and hard or easy quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: Column, seed: int) -> Column:
    """Draws are in order of the MD5 of key and seed: the same rows on any engine and any partitioning."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def cap(df: DataFrame, n: int, key: Column, seed: int, *group: str) -> DataFrame:
    """At most n rows of each group. Every task drops all but n of a group before the shuffle."""
    order = Window.partitionBy(*group).orderBy(order_key(key, seed), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def cap_all(df: DataFrame, n: int, key: Column, seed: int) -> DataFrame:
    return df.orderBy(order_key(key, seed), key).limit(n)


def hard_easy(df: DataFrame, n: int, share: float, wrong: Column, key: Column, seed: int, group: str) -> DataFrame:
    """Of each group up to int(n * share) wrong rows, and right ones up to n; too few right rows aren't made up for."""
    most = int(n * share)
    order = Window.partitionBy(group, "_wrong").orderBy(order_key(key, seed), key)
    got = df.withColumn("_wrong", wrong).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    # At most 2 n rows of a group are left to count.
    hard = F.count_if(F.col("_wrong") & (F.col("_n") <= most)).over(Window.partitionBy(group))
    room = F.when(F.col("_wrong"), F.lit(most)).otherwise(n - F.col("_h"))
    return got.withColumn("_h", hard).where(F.col("_n") <= room).withColumnRenamed("_wrong", "is_hard").drop("_n", "_h")
