"""Universal transverse Mercator by series, as column expressions.

Kruger's series in the third flattening, to its fourth power, on WGS 84: good to less than a millimetre
within some thousand kilometres of the central meridian. Angles are degrees, lengths metres. A
zone is the usual one of six degrees; the exceptions around Norway aren't made.

Each transformation has three steps, whose results are named before the next one uses them, so that
in vertex arrays no step is evaluated again for each term of the series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import area

# The ellipsoid, and the grid's scale and false origin.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Scaled radius of the sphere whose meridian is as long as the ellipsoid's.
RADIUS = SCALE * SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Coefficient j of a series from its own coefficients of the powers j, j + 1, ... of the third flattening."""
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


# The published coefficients of the series: forward, inverse, and conformal to geographic latitude.
FORWARD = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
INVERSE = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
LATITUDE = _series((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def utm_zone(lon: Column) -> Column:
    """1 to 60; 180 degrees east is 180 west."""
    return (F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)) + 1).cast("int")


def central_meridian(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def _to_sphere(lon: Column, lat: Column, meridian: Column) -> tuple[Column, Column]:
    """Tangent of the conformal latitude, and longitude from the meridian."""
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s)), F.radians(lon - meridian)


def _to_cylinder(t: Column, angle: Column) -> tuple[Column, Column]:
    return F.atan2(t, F.cos(angle)), F.asinh(F.sin(angle) / F.sqrt(t * t + F.cos(angle) * F.cos(angle)))


def _to_grid(xi: Column, eta: Column, south: Column) -> tuple[Column, Column]:
    e = sum((a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta) for j, a in enumerate(FORWARD, 1)), eta)
    n = sum((a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta) for j, a in enumerate(FORWARD, 1)), xi)
    return FALSE_EASTING + RADIUS * e, RADIUS * n + F.when(south, FALSE_NORTHING).otherwise(0.0)


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing; ``south`` tells whether northings count from ten million at the equator."""
    return _to_grid(*_to_cylinder(*_to_sphere(lon, lat, central_meridian(zone))), south)


def _from_grid(easting: Column, northing: Column, south: Column) -> tuple[Column, Column]:
    return (northing - F.when(south, FALSE_NORTHING).otherwise(0.0)) / RADIUS, (easting - FALSE_EASTING) / RADIUS


def _from_cylinder(xi: Column, eta: Column) -> tuple[Column, Column]:
    x = sum((-b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta) for j, b in enumerate(INVERSE, 1)), xi)
    e = sum((-b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta) for j, b in enumerate(INVERSE, 1)), eta)
    return x, e


def _from_sphere(xi: Column, eta: Column) -> tuple[Column, Column]:
    """Conformal latitude and longitude from the meridian, in radians."""
    return F.asin(F.sin(xi) / F.cosh(eta)), F.atan2(F.sinh(eta), F.cos(xi))


def _to_degrees(conformal: Column, angle: Column, meridian: Column) -> tuple[Column, Column]:
    lat = sum((d * F.sin(2.0 * j * conformal) for j, d in enumerate(LATITUDE, 1)), conformal)
    return meridian + F.degrees(angle), F.degrees(lat)


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude."""
    return _to_degrees(*_from_sphere(*_from_cylinder(*_from_grid(easting, northing, south))), central_meridian(zone))


def _steps(xs: Column, ys: Column, first, *others) -> tuple[Column, Column]:
    """The two arrays that come of a chain of steps on the pairs of ``xs`` and ``ys``."""
    named = lambda pair: F.struct(pair[0].alias("a"), pair[1].alias("b"))
    v = F.zip_with(xs, ys, lambda x, y: named(first(x, y)))
    taken = lambda step: lambda p: named(step(p["a"], p["b"]))
    for step in others:
        v = F.transform(v, taken(step))
    return v["a"], v["b"]


def vertices_to_utm(lons: Column, lats: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Vertex arrays of eastings and northings."""
    return _steps(lons, lats, lambda x, y: _to_sphere(x, y, central_meridian(zone)), _to_cylinder, lambda a, b: _to_grid(a, b, south))


def vertices_from_utm(eastings: Column, northings: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Vertex arrays of longitudes and latitudes."""
    return _steps(eastings, northings, lambda x, y: _from_grid(x, y, south), _from_cylinder, _from_sphere, lambda a, b: _to_degrees(a, b, central_meridian(zone)))


def estimated_zones(shapes: DataFrame, *layer: str) -> DataFrame:
    """layer, zone, south: of the centre of each layer's bounds. ``shapes``: layer, xs, ys in degrees."""
    box = shapes.groupBy(*layer).agg(*(f(g(c)).alias(f"{n}{c}") for c in ("xs", "ys") for n, f, g in (("lo", F.min, F.array_min), ("hi", F.max, F.array_max))))
    return box.select(*layer, utm_zone((F.col("loxs") + F.col("hixs")) / 2).alias("zone"), ((F.col("loys") + F.col("hiys")) < 0).alias("south"))


def projected_area(lons: Column, lats: Column, zone: Column, south: Column) -> Column:
    """Square metres of a polygon in the plane of the zone: shoelace over its projected vertices."""
    return area(*vertices_to_utm(lons, lats, zone, south))


def bounds_from_utm(xmin: Column, ymin: Column, xmax: Column, ymax: Column, zone: Column, south: Column, points: int = 21) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a box of the grid: each side is followed at ``points`` places between its corners."""
    part = F.transform(F.sequence(F.lit(0), F.lit(points + 1)), lambda k: k / float(points + 1))
    along = lambda a, b: F.transform(part, lambda t: a + (b - a) * t)
    fixed = lambda a: F.transform(part, lambda t: a + 0 * t)
    xs = F.concat(along(xmin, xmax), along(xmin, xmax), fixed(xmin), fixed(xmax))
    ys = F.concat(fixed(ymin), fixed(ymax), along(ymin, ymax), along(ymin, ymax))
    lons, lats = vertices_from_utm(xs, ys, zone, south)
    return F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)
