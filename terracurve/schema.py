"""Class codes, the date axis, and the contract of feature columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Class codes, and the 35 eight-day dates.
CODES = {"cotton": 1, "rice": 2, "sugarcane": 3, "other": 4, "fall_maize": 5, "orchard": 6}
NAMES = {v: k for k, v in CODES.items()}
NODATA = 255
FIRST_DATE, N_DATES, STEP_DAYS = dt.date(2025, 4, 1), 35, 8
DATES = [(FIRST_DATE + dt.timedelta(days=STEP_DAYS * i)).isoformat() for i in range(N_DATES)]
ACRE_M2, PIXEL_ACRES = 4046.86, 0.02471


class ContractError(ValueError):
    """The data break a contract that later steps rely on."""


def require_dates(columns: list[str], dates: list[str] = DATES, source: str = "table") -> None:
    """Every date must be a column, and the dates' places must ascend; other columns may stand between."""
    places = {name: at for at, name in enumerate(columns)}
    missing = sorted(set(dates) - places.keys())
    if missing:
        raise ContractError(f"{source}: {len(missing)} of {len(dates)} dates absent, from {missing[0]} to {missing[-1]}")
    for earlier, later in zip(dates, dates[1:], strict=False):
        if places[earlier] > places[later]:
            raise ContractError(f"{source}: out of order, {later} stands before {earlier}")


def check_labelled(df: DataFrame, dates: list[str] = DATES, codes: dict[str, int] = CODES) -> DataFrame:
    """Checks columns, codes, values, and that there are two classes and two tiles; returns ``df`` with label and tile cast.

    One aggregation finds all that the data can break.
    """
    for c in ("label", "tile"):
        if c not in df.columns:
            raise ContractError(f"column {c} is missing")
    require_dates(df.columns, dates)
    df = df.withColumn("label", F.col("label").cast("int")).withColumn("tile", F.col("tile").cast("string"))
    bad = None
    for d in dates:
        x = F.col(f"`{d}`")
        one = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        bad = one if bad is None else bad | one
    known = F.col("label").isin(list(codes.values()))
    r = df.agg(F.array_sort(F.collect_set(F.when(~known, F.col("label")))).alias("unknown"), F.count_if(bad).alias("bad"), F.count_distinct("label").alias("classes"), F.count_distinct("tile").alias("tiles")).first()
    if r["unknown"]:
        raise ContractError(f"unknown label codes: {r['unknown']}")
    if r["bad"]:
        raise ContractError(f"{r['bad']} rows have missing or non-finite features")
    if r["classes"] < 2 or r["tiles"] < 2:
        raise ContractError(f"two classes and two tiles are needed; there are {r['classes']} and {r['tiles']}")
    return df
