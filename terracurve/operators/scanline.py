"""Polygons on the pixel grid by scanlines: no pixel is tested against a polygon.

Shapes have xs and ys in pixel coordinates: pixel (row, col) is the square from (col, row) to
(col + 1, row + 1). Edges are dealt to the rows they meet, which leaves the vertex arrays behind;
what a row holds of a shape are spans of columns, and pixels come from spans. Work is that of the edges'
rows and the pixels covered. Several rows of the same keys are the rings of one shape, so holes are rings
too (even-odd rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import edges


def edge_rows(shapes: DataFrame, *keys: str) -> DataFrame:
    """keys, x1, y1, x2, y2: one row an edge; edges of no length are left out."""
    e = shapes.select(*keys, F.explode(edges(F.col("xs"), F.col("ys"))).alias("e")).select(*keys, "e.*")
    return e.where("x1 <> x2 or y1 <> y2")


def _along(df: DataFrame, name: str, first: Column, last: Column) -> DataFrame:
    """``df`` once for each whole number from ``first`` to ``last``; not at all if there is none."""
    return df.where(first <= last).withColumn(name, F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _low(a: str, b: str) -> Column:
    return F.least(a, b)


def _high(a: str, b: str) -> Column:
    return F.greatest(a, b)


def spans(shapes: DataFrame, *keys: str) -> DataFrame:
    """keys, row, first, last: columns of each row whose centres a shape holds. ``keys`` name a shape.

    Half-open as in the ray test: shapes that share a border share no pixel.
    """
    e = edge_rows(shapes, *keys)
    e = _along(e, "row", F.ceil(_low("y1", "y2") - 0.5), F.ceil(_high("y1", "y2") - 0.5) - 1)
    x = (F.col("x2") - F.col("x1")) * (F.col("row") + 0.5 - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    order = Window.partitionBy(*keys, "row").orderBy("x")
    met = e.select(*keys, "row", x.alias("x")).withColumn("n", F.row_number().over(order)).withColumn("to", F.lead("x").over(order)).where("n % 2 = 1")
    return met.select(*keys, "row", F.ceil(F.col("x") - 0.5).alias("first"), (F.ceil(F.col("to") - 0.5) - 1).alias("last")).where("first <= last")


def _pixels(found: DataFrame, *names: str) -> DataFrame:
    return _along(found, "col", F.col("first"), F.col("last")).select(*names, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


def burn(pixels: DataFrame, shapes: DataFrame, key: str = "id", label: str = "crop") -> DataFrame:
    """row, col, label: pixels whose centre lies in a shape of that label, each once."""
    cells = _pixels(spans(shapes, key, label), label).distinct()
    # Merged, as the planner guesses pixels by their files, which are far smaller than a table of them for a broadcast.
    return pixels.select("row", "col").join(cells.hint("merge"), ["row", "col"]).select("row", "col", label)


def within(pixels: DataFrame, shapes: DataFrame, key: str = "id", outside: bool = False) -> DataFrame:
    """Pixels whose centre lies in any shape, or in none."""
    return pixels.join(_pixels(spans(shapes, key)).distinct(), ["row", "col"], "left_anti" if outside else "left_semi")


def border(shapes: DataFrame, *keys: str) -> DataFrame:
    """keys, x1, y1, x2, y2, row, first, last: columns of each row whose closed squares an edge meets."""
    e = _along(edge_rows(shapes, *keys), "row", F.ceil(_low("y1", "y2") - 1), F.floor(_high("y1", "y2")))
    # The part of the edge in the row's band; an end that lies in it is taken as it is.
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))

    def at(y: Column) -> Column:
        return F.when(y == F.col("y2"), F.col("x2")).otherwise(F.col("x1") + (y - F.col("y1")) * slope)

    a, b = at(F.greatest(_low("y1", "y2"), F.col("row").cast("double"))), at(F.least(_high("y1", "y2"), F.col("row") + 1.0))
    flat = F.col("y1") == F.col("y2")
    low, high = F.when(flat, _low("x1", "x2")).otherwise(F.least(a, b)), F.when(flat, _high("x1", "x2")).otherwise(F.greatest(a, b))
    return e.select(*keys, "x1", "y1", "x2", "y2", "row", F.ceil(low - 1).alias("first"), F.floor(high).alias("last")).where("first <= last")


def touched(pixels: DataFrame, shapes: DataFrame, key: str = "id") -> DataFrame:
    """row, col of pixels whose closed square a shape meets: those along its border, and those whose centre it holds."""
    cells = _pixels(border(shapes, key)).unionByName(_pixels(spans(shapes, key))).distinct()
    return pixels.select("row", "col").join(cells, ["row", "col"], "left_semi")
