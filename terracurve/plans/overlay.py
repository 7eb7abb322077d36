"""Queries that lay polygons over each other, over cells, and around points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import projection as pr
from ..operators import arrangement as ar
from ..operators import nearness
from ..schema import ACRE_M2, PIXEL_ACRES
from ..sources.adapters import POINTS_SQL, STARS_SQL, points, read, stars
from .cells import _SHORT_SQL, _WIDE_SQL, SEGMENTS, short_cells, wide_cells
from .mapping import _FIELD, _ZONE_SQL, _to_utm_sql
from .registry import query

#: Corners of an area around its middle: a concave one.
_AREA = [(-9.3, -5.1), (7.2, -6.4), (9.7, 5.3), (0.6, -1.2), (-6.8, 7.9)]


def areas(spark, sf_dir):
    """aoi, xs, ys: a larger area for every fourth supplier, in the pixels of ``stars``."""
    k = F.col("s_suppkey")
    x, y = 1.713 + (k * 23 % 45), 1.177 + k * 0.4
    at = lambda c, i: F.array(*(c + v[i] for v in _AREA))
    return read(spark, sf_dir, "supplier").where(k % 4 == 0).select(k.alias("aoi"), at(x, 0).alias("xs"), at(y, 1).alias("ys"))


_AREAS_SQL = f"""acorner(j, dx, dy) as (values {", ".join(f"({j}, {x}::double, {y}::double)" for j, (x, y) in enumerate(_AREA))}),
ac as (select s_suppkey aoi, j, 1.713::double + (s_suppkey * 23 % 45) + dx x, 1.177::double + s_suppkey * 0.4::double + dy y from supplier, acorner where s_suppkey % 4 = 0),
area as (select a.aoi, a.j, a.x x1, a.y y1, b.x x2, b.y y2 from ac a join ac b on a.aoi = b.aoi and b.j = (a.j + 1) % {len(_AREA)})"""


def _common_sql(keys: str, source: str) -> str:
    """CTEs up to shared(keys, area): the area that the two layers of ``source`` (keys, layer, j, x1, y1, x2, y2, ccw: 1 for a ring that
    turns left) have in common, from the pieces of either border that lie in the other."""
    k = keys.split(", ")
    on = " and ".join(f"a.{c} = b.{c}" for c in k)
    a = ", ".join(f"a.{c}" for c in k)
    m = on.replace("a.", "m.")
    return f"""met as (select {a}, a.layer, a.j, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) d, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) tn,
 (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) un from {source} a join {source} b on {on} and a.layer <> b.layer),
cuts as (select {keys}, layer, j, tn / d t from met where d <> 0 and tn / d between 0 and 1 and un / d between 0 and 1 union select {keys}, layer, j, 0 from {source} union select {keys}, layer, j, 1 from {source}),
pieces as (select *, lead(t) over (partition by {keys}, layer, j order by t) t2 from cuts),
m as (select s.*, p.t, p.t2, x1 + (x2 - x1) * (t + t2) / 2 mx, y1 + (y2 - y1) * (t + t2) / 2 my from pieces p join {source} s using ({keys}, layer, j) where t2 > t),
held as (select m.layer, m.j, m.t, {", ".join(f"m.{c}" for c in k)}, any_value(m.ccw * ((m.x1 + (m.x2 - m.x1) * m.t) * (m.y1 + (m.y2 - m.y1) * m.t2) - (m.x1 + (m.x2 - m.x1) * m.t2) * (m.y1 + (m.y2 - m.y1) * m.t))) c
 from m join {source} b on {m} and m.layer <> b.layer and (b.y1 > my) <> (b.y2 > my) and mx < (b.x2 - b.x1) * (my - b.y1) / (b.y2 - b.y1) + b.x1 group by all having count(*) % 2 = 1),
shared as (select {keys}, sum(c) / 2 area from held group by {keys})"""


@query(f"""with {STARS_SQL}, {_AREAS_SQL},
o1 as (select id, sign(sum(x1 * y2 - x2 * y1)) ccw from star group by id), o2 as (select aoi, sign(sum(x1 * y2 - x2 * y1)) ccw from area group by aoi),
b1 as (select id, min(x1) a, max(x1) b, min(y1) c, max(y1) d from star group by id), b2 as (select aoi, min(x1) a, max(x1) b, min(y1) c, max(y1) d from area group by aoi),
pr as (select id, aoi from b1 join b2 on b1.a <= b2.b and b2.a <= b1.b and b1.c <= b2.d and b2.c <= b1.d),
e as (select id, aoi, 0 layer, j, x1, y1, x2, y2, ccw from pr join star using (id) join o1 using (id) union all select id, aoi, 1, j, x1, y1, x2, y2, ccw from pr join area using (aoi) join o2 using (aoi)), {_common_sql("id, aoi", "e")}
select id, aoi, round(area * {PIXEL_ACRES}::double, 4) acres from shared where round(area * {PIXEL_ACRES}::double, 4) > 0""")
def clip_polygons(spark, sf_dir):
    """Acres of each field within each area that it meets; neither is convex."""
    a, b = stars(spark, sf_dir), areas(spark, sf_dir)
    pairs = ar.met_in_cells(a, b, 16.0, "id", "aoi")
    parts = ar.overlaid(pairs.join(a.select("id", "xs", "ys"), "id"), pairs.join(b, "aoi"), "id", "aoi").where("in0 and in1")
    by = parts.groupBy("id", "aoi").agg(F.round(F.sum(ar.trapezoid_area()) * PIXEL_ACRES, 4).alias("acres"))
    return by.where("acres > 0")


def _fields_of_points(spark, sf_dir):
    """id, class, xs, ys: a field around each point, larger for more acres."""
    size = 0.2 + F.col("acres") / 100
    at = lambda c, i: F.array(*(F.col(c) + v[i] * size for v in _FIELD))
    return points(spark, sf_dir).select("id", "class", at("lon", 0).alias("xs"), at("lat", 1).alias("ys"))


_CELL = 0.1


@query(f"""with {_SHORT_SQL.removeprefix("with ")}, fcorner(j, dx, dy) as (values {", ".join(f"({j}, {x}::double, {y}::double)" for j, (x, y) in enumerate(_FIELD))}),
fv as (select id, "class", fcorner.j, p.lon + dx * (0.2::double + acres / 100) lon, p.lat + dy * (0.2::double + acres / 100) lat from pts p, fcorner),
zone as (select {_ZONE_SQL.format(lon="(min(lon) + max(lon)) / 2")} zone, min(lat) + max(lat) < 0 south from fv),
fz as (select fv.*, zone, south from fv, zone), {_to_utm_sql("fu", "fz")},
fb as (select id, floor(min(lon) / {_CELL}::double)::bigint i0, floor(max(lon) / {_CELL}::double)::bigint i1, floor(min(lat) / {_CELL}::double)::bigint j0, floor(max(lat) / {_CELL}::double)::bigint j1 from fv group by id),
pr as (select id, i, j cj from fb join short on i between i0 and i1 and j between j0 and j1),
cv as (select i, j cj, k, (i + kx) * {_CELL}::double lon, (j + ky) * {_CELL}::double lat, zone, south from short, (values (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) c(k, kx, ky), zone), {_to_utm_sql("cu", "cv")},
fe as (select a.id, a.j, a.e x1, a.n y1, b.e x2, b.n y2 from fu a join fu b on a.id = b.id and b.j = (a.j + 1) % {len(_FIELD)}),
ce as (select a.i, a.cj, a.k j, a.e x1, a.n y1, b.e x2, b.n y2 from cu a join cu b on a.i = b.i and a.cj = b.cj and b.k = (a.k + 1) % 4),
o1 as (select id, sign(sum(x1 * y2 - x2 * y1)) ccw from fe group by id),
e as (select id, i, cj, 0 layer, fe.j, x1, y1, x2, y2, ccw from pr join fe using (id) join o1 using (id) union all select id, i, cj, 1, ce.j, x1, y1, x2, y2, 1 from pr join ce using (i, cj)), {_common_sql("id, i, cj", "e")}
select i, cj j, {", ".join(f'''round(coalesce(sum(area) filter ("class" = '{s}'), 0) / {ACRE_M2}::double, 3) {c}''' for s, c in SEGMENTS.items())} from shared join (select distinct id, "class" from pts) using (id) group by i, cj""")
def exact_cell_acres(spark, sf_dir):
    """Acres of each class in the shortlisted cells, from fields clipped to the cell, in the plane of their zone."""
    f, short = _fields_of_points(spark, sf_dir), short_cells(spark, sf_dir).select("i", "j")  # at most 60 cells
    zone = pr.estimated_zones(f)
    utm = lambda df: pr.vertices_to_utm(df["xs"], df["ys"], F.col("zone"), F.col("south"))

    def projected(df, *keys):
        met = df.join(F.broadcast(zone), F.lit(True))  # one row
        xs, ys = utm(met)
        return met.select(*keys, xs.alias("xs"), ys.alias("ys"))

    along = lambda v, name: F.explode(F.sequence(F.floor(F.array_min(v) / _CELL), F.floor(F.array_max(v) / _CELL))).alias(name)
    met = f.select("*", along("xs", "i")).select("*", along("ys", "j")).join(F.broadcast(short), ["i", "j"])
    corner = lambda c, steps: F.array(*((F.col(c) + k) * _CELL for k in steps))
    cells = met.select("id", "i", "j", corner("i", (0, 1, 1, 0)).alias("xs"), corner("j", (0, 0, 1, 1)).alias("ys"))
    parts = ar.overlaid(projected(met, "id", "i", "j"), projected(cells, "id", "i", "j"), "id", "i", "j").where("in0 and in1")
    by = parts.groupBy("id", "i", "j").agg((F.sum(ar.trapezoid_area()) / ACRE_M2).alias("acres")).join(f.select("id", "class"), "id")
    return by.groupBy("i", "j").agg(*(F.round(F.coalesce(F.sum(F.when(F.col("class") == s, F.col("acres"))), F.lit(0.0)), 3).alias(c) for s, c in SEGMENTS.items()))


#: Corners of a ring that crosses itself, taken from the corners of a star.
_ORDER = (0, 3, 6, 1, 4, 7, 2, 5)


@query(f"""with {STARS_SQL}, c as (select a.id, a.j, a.x1, a.y1, b.x1 x2, b.y1 y2 from (select id, list_position([{", ".join(map(str, _ORDER))}], j) - 1 j, x1, y1 from star) a join (select id, list_position([{", ".join(map(str, _ORDER))}], j) - 1 j, x1, y1 from star) b on a.id = b.id and b.j = (a.j + 1) % 8),
met as (select a.id, a.j, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) d, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) tn, (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) un from c a join c b on a.id = b.id and a.j <> b.j),
cuts as (select id, j, tn / d t from met where d <> 0 and tn / d between 0 and 1 and un / d between 0 and 1 union select id, j, 0 from c union select id, j, 1 from c),
pieces as (select *, lead(t) over (partition by id, j order by t) t2 from cuts),
m as (select c.*, t, t2, x1 + (x2 - x1) * (t + t2) / 2 - 1e-7 * (y2 - y1) mx, y1 + (y2 - y1) * (t + t2) / 2 + 1e-7 * (x2 - x1) my from pieces join c using (id, j) where t2 - t > 1e-9),
w as (select m.id, m.j, m.t, any_value((m.x1 + (m.x2 - m.x1) * m.t) * (m.y1 + (m.y2 - m.y1) * m.t2) - (m.x1 + (m.x2 - m.x1) * m.t2) * (m.y1 + (m.y2 - m.y1) * m.t)) a,
 count(*) filter ((c.y1 > my) <> (c.y2 > my) and mx < (c.x2 - c.x1) * (my - c.y1) / (c.y2 - c.y1) + c.x1) % 2 = 1 inside from m join c on m.id = c.id group by m.id, m.j, m.t)
select id, round(sum(case when inside then a else -a end) / 2, 5) area from w group by id""")
def repaired_polygons(spark, sf_dir):
    """Area of what even-odd repair makes of rings that cross themselves."""
    s = stars(spark, sf_dir)
    pick = lambda c: F.array(*(F.col(c)[j] for j in _ORDER)).alias(c)
    parts = ar.repaired(s.select("id", pick("xs"), pick("ys")), "id")
    return parts.groupBy("id").agg(F.round(F.sum(ar.trapezoid_area()), 5).alias("area"))


_NEAR = 0.02
_BLOCK = [(-0.031, -0.022), (0.043, -0.017), (0.012, 0.008), (-0.007, 0.052)]


def _validation(spark, sf_dir):
    """id, xs, ys: areas of another purpose, in degrees, for every tenth supplier."""
    k = F.col("s_suppkey")
    x, y, size = 66.003 + (k * 31 % 120) / 100.0, 27.907 + (k * 57 % 120) / 100.0, 0.5 + k % 3
    at = lambda c, i: F.array(*(c + v[i] * size for v in _BLOCK))
    return read(spark, sf_dir, "supplier").where(k % 10 == 7).select(k.alias("id"), at(x, 0).alias("xs"), at(y, 1).alias("ys"))


_VALIDATION_SQL = f"""vcorner(j, dx, dy) as (values {", ".join(f"({j}, {x}::double, {y}::double)" for j, (x, y) in enumerate(_BLOCK))}),
vv as (select s_suppkey id, j, 66.003::double + (s_suppkey * 31 % 120) / 100.0::double + dx * (0.5::double + s_suppkey % 3) x, 27.907::double + (s_suppkey * 57 % 120) / 100.0::double + dy * (0.5::double + s_suppkey % 3) y from supplier, vcorner where s_suppkey % 10 = 7),
ve as (select a.id, a.j, a.x x1, a.y y1, b.x x2, b.y y2 from vv a join vv b on a.id = b.id and b.j = (a.j + 1) % {len(_BLOCK)})"""
_SEGMENT_SQL = "pow({x} - x1 - t * (x2 - x1), 2) + pow({y} - y1 - t * (y2 - y1), 2)"


def _ray_sql(x: str, y: str) -> str:
    return f"(y1 > {y}) <> (y2 > {y}) and {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1"


# A cell is near if its border crosses an area's, if a corner of either is near a side of the other, or if one holds the other.
@query(f"""with {_WIDE_SQL}, {_VALIDATION_SQL},
side(a, b) as (values (0, 0), (1, 0), (1, 1), (0, 1)),
box as (select i, j, (i + p.a) * {_CELL}::double px, (j + p.b) * {_CELL}::double py, (i + q.a) * {_CELL}::double qx, (j + q.b) * {_CELL}::double qy from wide, (select a, b, lead(a, 1, 0) over () a2, lead(b, 1, 0) over () b2 from side) p, side q where q.a = p.a2 and q.b = p.b2),
u as (select box.i, box.j, v.id, x1, y1, x2, y2, px, py, qx, qy, (x2 - x1) * (qy - py) - (y2 - y1) * (qx - px) d from box, ve v),
crossing as (select distinct i, j from u where d <> 0 and ((px - x1) * (qy - py) - (py - y1) * (qx - px)) / d between 0 and 1 and ((px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)) / d between 0 and 1),
ends as (select i, j, x1, y1, x2, y2, px x, py y from u union all select i, j, px, py, qx, qy, x1, y1 from u),
far as (select i, j, x, y, x1, y1, x2, y2, greatest(least(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 1), 0) t from ends),
close as (select distinct i, j from far where {_SEGMENT_SQL.format(x="x", y="y")} <= {_NEAR * _NEAR}::double),
corner_in as (select box.i, box.j from box, ve where {_ray_sql("px", "py")} group by box.i, box.j, id, px, py having count(*) % 2 = 1),
inner_ as (select distinct w.i, w.j from wide w, vv where x between w.i * {_CELL}::double and (w.i + 1) * {_CELL}::double and y between w.j * {_CELL}::double and (w.j + 1) * {_CELL}::double)
select i, j from wide where (i, j) not in (select (i, j) from crossing union select (i, j) from close union select (i, j) from corner_in union select (i, j) from inner_)""")
def buffered_exclusion(spark, sf_dir):
    """Cells farther than the buffer from every area of another purpose."""
    cells = wide_cells(spark, sf_dir).select("i", "j")
    return cells.join(nearness.cells_near(cells, _validation(spark, sf_dir), _CELL, _NEAR), ["i", "j"], "left_anti")


@query(f"""with {POINTS_SQL}, {_VALIDATION_SQL}, m as (select p.id point, v.*, lon x, lat y, greatest(least(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 1), 0) t from points p, ve v)
select point, id area from m where {_SEGMENT_SQL.format(x="x", y="y")} <= {_NEAR * _NEAR}::double union select point, id from m where {_ray_sql("y", "y").replace("y < (x2", "x < (x2")} group by point, id having count(*) % 2 = 1""")
def points_near_areas(spark, sf_dir):
    """Points in an area or within the buffer around it."""
    found = nearness.points_near(points(spark, sf_dir).select(F.col("id").alias("point"), "lon", "lat"), _validation(spark, sf_dir), _NEAR, "point", "lon", "lat")
    return found.select("point", F.col("id").alias("area"))


_UNION_CELL = 8.0


@query(f"""with {STARS_SQL}, o as (select id, sign(sum(x1 * y2 - x2 * y1)) ccw from star group by id), e as (select star.*, ccw from star join o using (id)),
met as (select a.id, a.j, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) d, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) tn, (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) un
 from e a join e b on a.crop = b.crop and a.id <> b.id and least(a.x1, a.x2) <= greatest(b.x1, b.x2) and least(b.x1, b.x2) <= greatest(a.x1, a.x2) and least(a.y1, a.y2) <= greatest(b.y1, b.y2) and least(b.y1, b.y2) <= greatest(a.y1, a.y2)),
cuts as (select id, j, tn / d t from met where d <> 0 and tn / d between 0 and 1 and un / d between 0 and 1 union select id, j, 0 from e union select id, j, 1 from e),
pieces as (select *, lead(t) over (partition by id, j order by t) t2 from cuts),
m as (select e.*, t, t2, x1 + (x2 - x1) * (t + t2) / 2 mx, y1 + (y2 - y1) * (t + t2) / 2 my from pieces join e using (id, j) where t2 > t),
held as (select distinct id, j, t from (select m.id, m.j, m.t, b.id other from m join e b on m.crop = b.crop and m.id <> b.id and (b.y1 > my) <> (b.y2 > my) and mx < (b.x2 - b.x1) * (my - b.y1) / (b.y2 - b.y1) + b.x1 group by all having count(*) % 2 = 1))
select crop, round(sum(ccw * ((x1 + (x2 - x1) * t) * (y1 + (y2 - y1) * t2) - (x1 + (x2 - x1) * t2) * (y1 + (y2 - y1) * t))) / 2 * {PIXEL_ACRES}::double, 4) acres from m anti join held using (id, j, t) group by crop""")
def dissolved_acres(spark, sf_dir):
    """Acres of each crop's fields as one shape: what several hold counts once."""
    parts = ar.dissolved(stars(spark, sf_dir), _UNION_CELL, "crop")
    return parts.groupBy("crop").agg(F.round(F.sum(ar.trapezoid_area()) * PIXEL_ACRES, 4).alias("acres"))


@query(f"""with {STARS_SQL}, k as (select id, id % 6 kind, abs(sum(x1 * y2 - x2 * y1)) / 2 a from star group by id) select id, round(a, 6) area from k where kind in (0, 5)""")
def usable_polygons(spark, sf_dir):
    """Fields of which some lack their vertices, a part of one, a corner, or any extent."""
    s, kind = stars(spark, sf_dir), F.col("id") % 6
    xs = F.when(kind == 1, F.lit(None)).when(kind == 2, F.concat("xs", F.array(F.lit(None).cast("double")))).when(kind == 3, F.slice("xs", 1, 2)).when(kind == 4, F.transform("ys", lambda y: 2 * y)).otherwise(F.col("xs"))
    ys = F.when(kind == 2, F.concat("ys", F.array(F.lit(0.0)))).when(kind == 3, F.slice("ys", 1, 2)).otherwise(F.col("ys"))
    df = s.select("id", xs.alias("xs"), ys.alias("ys"))
    return df.where(geo.usable(F.col("xs"), F.col("ys"))).select("id", F.round(geo.area(F.col("xs"), F.col("ys")), 6).alias("area"))
