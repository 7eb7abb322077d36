"""Curves: arrays of values on a regular date axis, null where missing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

LAMBDA, ORDER, BOUNDS = 0.5, 2, (-1.0, 1.0)


def let(x: Column, f) -> Column:
    """f(x), with x computed once: an expression that a lambda only refers to is computed anew for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normalized_difference(nir: Column, red: Column) -> Column:
    """Null unless the sum is positive."""
    total = nir + red
    return F.when(total > 0, (nir - red) / total)


def band_date(name: Column, prefix: str = "ndvi") -> Column:
    """Date of a band named ``prefix_YYYY_MM_DD``; null for other names."""
    found = F.regexp_extract(name, rf"^{prefix}_(\d{{4}}_\d{{2}}_\d{{2}})$", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy_MM_dd")).cast("date")


def date_axis(first: str, n: int, step: int = 8) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_add(F.lit(first).cast("date"), i * step))


def penalty_matrix(n: int, lam: float = LAMBDA, order: int = ORDER) -> np.ndarray:
    """lam * D'D, D the differences of that order."""
    d = np.diff(np.eye(n), order, axis=0)
    return lam * d.T @ d


def hat_matrix(n: int, lam: float = LAMBDA, order: int = ORDER) -> np.ndarray:
    """The matrix that smooths a complete curve of n values."""
    return np.linalg.inv(np.eye(n) + penalty_matrix(n, lam, order))


def smooth_complete(curve: Column, n: int, lam: float = LAMBDA, order: int = ORDER) -> Column:
    """Whittaker smoothing of curves without gaps, as products with constant rows."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in hat_matrix(n, lam, order)))
    dot = lambda row, y: F.aggregate(F.zip_with(row, y, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return let(curve, lambda y: F.transform(rows, lambda row: dot(row, y)))


def smoothed(curves: np.ndarray, lam: float = LAMBDA, order: int = ORDER, bounds: tuple[float, float] = BOUNDS) -> np.ndarray:
    """Whittaker smoothing of rows with NaN for missing. Rows with one gap pattern are solved together.

    Values outside ``bounds`` count as missing, results are held within them.
    Rows with fewer than ``order`` values have no unique solution and stay NaN.
    """
    out = np.full(curves.shape, np.nan)
    if not len(curves):
        return out
    seen = ~np.isnan(curves) & (curves >= bounds[0]) & (curves <= bounds[1])
    penalty = penalty_matrix(curves.shape[1], lam, order)
    patterns, of = np.unique(seen, axis=0, return_inverse=True)
    for i, w in enumerate(patterns):
        if w.sum() >= order:
            rows = np.flatnonzero(of.ravel() == i)
            y = np.where(w, np.nan_to_num(curves[rows]), 0.0)
            out[rows] = np.clip(np.linalg.solve(np.diag(w.astype(float)) + penalty, y.T).T, *bounds)
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def smooth(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whittaker smoothing of curves with gaps; null for a null curve or one with fewer than two values."""
    for part in parts:
        found = pd.Series([None] * len(part), index=part.index, dtype=object)
        size = part.map(lambda c: -1 if c is None else len(c))
        for n in set(size) - {-1, 0}:
            own = part[size == n]
            z = smoothed(np.array([np.asarray(c, dtype=float) for c in own]))
            for at, row in zip(own.index, z, strict=True):
                found[at] = None if np.isnan(row).all() else row
        yield found


def cut(curve: Column, first: int, n: int) -> Column:
    """n values from place ``first``, counted from 0."""
    return F.slice(curve, first + 1, n)


def has_value(curve: Column) -> Column:
    return F.exists(curve, lambda x: x.isNotNull())


def filled(curve: Column, value: float = 0.0) -> Column:
    return F.transform(curve, lambda x: F.coalesce(x, F.lit(value)))


def mean_abs(a: Column, b: Column) -> Column:
    """Mean absolute difference; null if any value is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def bands_by_date(name: Column, value: Column, prefix: str = "ndvi") -> Column:
    """An aggregate: the values of the bands that ``band_date`` knows, in order of their dates."""
    at = band_date(name, prefix)
    return F.transform(F.sort_array(F.collect_list(F.when(at.isNotNull(), F.struct(at.alias("at"), value.alias("v"))))), lambda s: s["v"])
