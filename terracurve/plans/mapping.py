"""Queries on projected coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projection as pr
from ..schema import ACRE_M2
from ..sources.adapters import GRID_SQL, grid, read
from .registry import query

_R = lambda c, n: F.round(c, n)


def _sum_sql(first: str, terms: list[float], a: str, b: str, sign: str = "+") -> str:
    """``first`` and the terms of a series: ``a`` and ``b`` have {j} for twice the number of the term."""
    return first + "".join(f" {sign} ({c!r}::double) * {a.format(j=2 * j)} * {b.format(j=2 * j)}" for j, c in enumerate(terms, 1))


def _to_utm_sql(name: str, source: str) -> str:
    """CTEs up to ``name``: the columns of ``source`` (lon, lat, zone, south, ...) with e and n."""
    e2 = repr(pr.ECCENTRICITY)
    return f"""{name}_1 as (select *, sinh(atanh(sin(radians(lat))) - {e2}::double * atanh({e2}::double * sin(radians(lat)))) t_, radians(lon - (zone * 6.0::double - 183)) l_ from {source}),
{name}_2 as (select *, atan2(t_, cos(l_)) xi_, asinh(sin(l_) / sqrt(t_ * t_ + cos(l_) * cos(l_))) eta_ from {name}_1),
{name} as (select * exclude (t_, l_, xi_, eta_), {pr.FALSE_EASTING}::double + {pr.RADIUS!r}::double * ({_sum_sql("eta_", pr.FORWARD, "cos({j} * xi_)", "sinh({j} * eta_)")}) e,
 {pr.RADIUS!r}::double * ({_sum_sql("xi_", pr.FORWARD, "sin({j} * xi_)", "cosh({j} * eta_)")}) + case when south then {pr.FALSE_NORTHING}::double else 0 end n from {name}_2)"""


def _from_utm_sql(name: str, source: str) -> str:
    """CTEs up to ``name``: the columns of ``source`` (e, n, zone, south, ...) with lon2 and lat2."""
    return f"""{name}_1 as (select *, (n - case when south then {pr.FALSE_NORTHING}::double else 0 end) / {pr.RADIUS!r}::double a_, (e - {pr.FALSE_EASTING}::double) / {pr.RADIUS!r}::double b_ from {source}),
{name}_2 as (select *, {_sum_sql("a_", pr.INVERSE, "sin({j} * a_)", "cosh({j} * b_)", "-")} xi_, {_sum_sql("b_", pr.INVERSE, "cos({j} * a_)", "sinh({j} * b_)", "-")} eta_ from {name}_1),
{name}_3 as (select *, asin(sin(xi_) / cosh(eta_)) f_ from {name}_2),
{name} as (select * exclude (a_, b_, xi_, eta_, f_), (zone * 6.0::double - 183) + degrees(atan2(sinh(eta_), cos(xi_))) lon2, degrees({_sum_sql("f_", pr.LATITUDE, "sin({j} * f_)", "1")}) lat2 from {name}_3)"""


_ZONE_SQL = "((floor(({lon} + 180.0::double) / 6.0::double)::bigint % 60 + 60) % 60 + 1)::int"


@query(f"""with p as (select c_custkey id, -180.0::double + (c_custkey * 7919 % 36000) / 100.0::double lon, -80.0::double + (c_custkey * 104729 % 16400) / 100.0::double lat from customer),
z as (select *, {_ZONE_SQL.format(lon="lon")} zone, lat < 0 south from p), {_to_utm_sql("u", "z")}, {_from_utm_sql("b", "u")}
select id, zone, round(e, 3) easting, round(n, 3) northing, round(lon2, 8) lon, round(lat2, 8) lat from b""")
def utm_roundtrip(spark, sf_dir):
    """Points all over the world: their zone, their place in it, and the degrees that this place leads back to."""
    k = F.col("c_custkey")
    p = read(spark, sf_dir, "customer").select(k.alias("id"), (-180.0 + (k * 7919 % 36000) / 100.0).alias("lon"), (-80.0 + (k * 104729 % 16400) / 100.0).alias("lat"))
    p = p.withColumn("zone", pr.utm_zone(F.col("lon"))).withColumn("south", F.col("lat") < 0)
    e, n = pr.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))
    p = p.select("id", "zone", "south", e.alias("e"), n.alias("n"))
    lon, lat = pr.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    return p.select("id", "zone", _R("e", 3).alias("easting"), _R("n", 3).alias("northing"), _R(lon, 8).alias("lon"), _R(lat, 8).alias("lat"))


#: Vertices of a field around its centre, in degrees for a size of 1.
_FIELD = [(-0.010, -0.008), (0.012, -0.009), (0.015, 0.004), (0.002, 0.001), (-0.003, 0.013)]


def fields(spark, sf_dir):
    """id, layer, xs, ys: fields of five corners in degrees, of 25 layers that lie far apart."""
    k, layer = F.col("s_suppkey"), F.col("s_nationkey")
    x = -170.0 + layer * 13.7 + (k * 31 % 100) / 100.0
    y = -60.0 + layer * 5.1 + (k * 57 % 100) / 100.0
    size = (1 + k % 7) / 4.0
    at = lambda c, i: F.array(*(c + v[i] * size for v in _FIELD))
    return read(spark, sf_dir, "supplier").select(k.alias("id"), layer.alias("layer"), at(x, 0).alias("xs"), at(y, 1).alias("ys"))


_FIELDS_SQL = """f as (select s_suppkey id, s_nationkey layer, -170.0::double + s_nationkey * 13.7::double + (s_suppkey * 31 % 100) / 100.0::double x, -60.0::double + s_nationkey * 5.1::double + (s_suppkey * 57 % 100) / 100.0::double y,
 (1 + s_suppkey % 7) / 4.0::double s from supplier),
corner(i, dx, dy) as (values """ + ", ".join(f"({i}, {x}::double, {y}::double)" for i, (x, y) in enumerate(_FIELD)) + """),
v as (select id, layer, i, x + dx * s lon, y + dy * s lat from f, corner)"""


@query(f"""with {_FIELDS_SQL}, b as (select layer, (min(lon) + max(lon)) / 2 c, min(lat) + max(lat) < 0 south from v group by layer),
z as (select v.*, {_ZONE_SQL.format(lon="c")} zone, south from v join b using (layer)), {_to_utm_sql("u", "z")},
s as (select *, lead(e) over w e2, lead(n) over w n2, first_value(e) over w e1, first_value(n) over w n1 from u window w as (partition by id order by i rows between unbounded preceding and unbounded following))
select id, layer, zone, round(abs(sum(e * coalesce(n2, n1) - coalesce(e2, e1) * n)) / 2 / {ACRE_M2}::double, 4) acres from s group by id, layer, zone""")
def projected_acres(spark, sf_dir):
    """Acres of every field in the zone of its layer."""
    f = fields(spark, sf_dir)
    z = f.join(F.broadcast(pr.estimated_zones(f, "layer")), "layer")  # a row for each of 25 layers
    acres = pr.projected_area(F.col("xs"), F.col("ys"), F.col("zone"), F.col("south")) / ACRE_M2
    return z.select("id", "layer", "zone", F.round(acres, 4).alias("acres"))


#: Upper left corner and side of the pixels of the grid in zone 42 north.
_ORIGIN, _SIDE, _ZONE = (305_000.0, 3_160_000.0), 10.0, 42


@query(f"""with {GRID_SQL}, q as (select "row", col, {_ORIGIN[0]}::double + (col + 0.5::double) * {_SIDE} e, {_ORIGIN[1]}::double - ("row" + 0.5::double) * {_SIDE} n, {_ZONE} zone, false south from grid), {_from_utm_sql("b", "q")}
select "row", col, round(lon2, 8) lon, round(lat2, 8) lat from b""")
def pixel_lonlat(spark, sf_dir):
    """Degrees of the pixels' centres, whose grid is in metres."""
    e, n = _ORIGIN[0] + (F.col("col") + 0.5) * _SIDE, _ORIGIN[1] - (F.col("row") + 0.5) * _SIDE
    lon, lat = pr.from_utm(e, n, F.lit(_ZONE), F.lit(False))
    return grid(spark, sf_dir).select("row", "col", _R(lon, 8).alias("lon"), _R(lat, 8).alias("lat"))


@query(f"""with {GRID_SQL}, t as (select "row" // 10 tr, col // 10 tc, min("row") r0, max("row") + 1 r1, min(col) c0, max(col) + 1 c1 from grid group by all),
x as (select tr, tc, {_ORIGIN[0]}::double + c0 * {_SIDE} x0, {_ORIGIN[0]}::double + c1 * {_SIDE} x1, {_ORIGIN[1]}::double - r1 * {_SIDE} y0, {_ORIGIN[1]}::double - r0 * {_SIDE} y1 from t),
k as (select *, unnest(range(23)) / 22.0::double t from x),
q as (select tr, tc, unnest([x0 + (x1 - x0) * t, x0 + (x1 - x0) * t, x0, x1]) e, unnest([y0, y1, y0 + (y1 - y0) * t, y0 + (y1 - y0) * t]) n, {_ZONE} zone, false south from k), {_from_utm_sql("b", "q")}
select tr, tc, round(min(lon2), 8) west, round(min(lat2), 8) south, round(max(lon2), 8) east, round(max(lat2), 8) north from b group by tr, tc""")
def tile_bounds_lonlat(spark, sf_dir):
    """Bounds in degrees of tiles of ten by ten pixels."""
    tile = [F.expr("cast(row div 10 as long)").alias("tr"), F.expr("cast(col div 10 as long)").alias("tc")]
    t = grid(spark, sf_dir).groupBy(*tile).agg(F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"), F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"))
    x, y = lambda c: _ORIGIN[0] + F.col(c) * _SIDE, lambda r: _ORIGIN[1] - F.col(r) * _SIDE
    box = pr.bounds_from_utm(x("c0"), y("r1"), x("c1"), y("r0"), F.lit(_ZONE), F.lit(False))
    return t.select("tr", "tc", *(_R(b, 8).alias(n) for b, n in zip(box, ("west", "south", "east", "north"), strict=True)))
