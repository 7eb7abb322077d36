"""Queries on pixels and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as r
from ..operators import scanline
from ..schema import CODES, PIXEL_ACRES
from ..sources.adapters import GRID_SQL, POLYGONS, STARS_SQL, grid, polygons, stars
from .registry import query

KEYS = ("row", "col")


def _edges_sql(name: str, shapes) -> str:
    rows = []
    for n, (crop, v) in enumerate(shapes):
        for (x1, y1), (x2, y2) in zip(v, v[1:] + v[:1], strict=True):
            rows.append(f"({n}, '{crop}', {x1}::double, {y1}::double, {x2}::double, {y2}::double)")
    return f"{name}(poly, crop, x1, y1, x2, y2) as (values {', '.join(rows)})"


def _inside_sql(edges: str, pixels: str) -> str:
    """row, col, crop of pixels in a polygon of that crop."""
    return f"""select distinct "row", col, crop from (select g."row", g.col, e.crop, e.poly from {pixels} g join {edges} e on (y1 > g."row" + 0.5) <> (y2 > g."row" + 0.5)
 and g.col + 0.5 < (x2 - x1) * (g."row" + 0.5 - y1) / nullif(y2 - y1, 0) + x1 group by all having count(*) % 2 = 1)"""


_EDGES = _edges_sql("edges", POLYGONS)
_BOXES = [("block", [(4, 4), (12.5, 4), (12.5, 9.25), (4, 9.25)]), ("block", [(33, 27), (41, 27), (41, 33), (33, 33)])]
_AOI = [("aoi", [(0, 0), (36, 0), (36, 34), (0, 34)])]
_VALIDATION = [("val", [(10, 8), (22, 8), (22, 18), (10, 18)])]
_BURNED = f"burned as ({_inside_sql('edges', 'grid')})"


def _touch_sql(boxes) -> str:
    conds = [f'(col <= {max(x for x, _ in v)} and col + 1 >= {min(x for x, _ in v)} and "row" <= {max(y for _, y in v)} and "row" + 1 >= {min(y for _, y in v)})' for _, v in boxes]
    return " or ".join(conds)


@query(f'with {GRID_SQL}, {_EDGES} select "row", col, crop from ({_inside_sql("edges", "grid")})')
def point_in_polygon(spark, sf_dir):
    return scanline.burn(grid(spark, sf_dir), polygons(spark))


_RAY = """select distinct "row", col{crop} from (select g."row", g.col, s.crop, s.id from grid g join star s on (y1 > g."row" + 0.5) <> (y2 > g."row" + 0.5)
 and g.col + 0.5 < (x2 - x1) * (g."row" + 0.5 - y1) / (y2 - y1) + x1 group by all having count(*) % 2 = 1)"""


@query(f"with {GRID_SQL}, {STARS_SQL} {_RAY.format(crop=', crop')}")
def scanline_burn(spark, sf_dir):
    """Pixels whose centre lies in a field, by crop."""
    return scanline.burn(grid(spark, sf_dir), stars(spark, sf_dir))


@query(f"""with {GRID_SQL}, {STARS_SQL}, b as ({_RAY.format(crop=', crop')}), n as (select "row", col, count(*) n, min(crop) crop from b group by all)
select "row", col, case crop {" ".join(f"when '{k}' then {v}" for k, v in CODES.items())} end code from grid join n using ("row", col) where n = 1""")
def usable_label_pixels(spark, sf_dir):
    """Pixels with a usable label: some class claims them, and no other does."""
    g = grid(spark, sf_dir).select("row", "col")
    return r.usable_labels(r.coded(g, scanline.burn(g, stars(spark, sf_dir)), CODES)).select("row", "col", "code")


# A segment meets a square if neither a side of the square nor the segment's own line lies between them.
@query(f"""with {GRID_SQL}, {STARS_SQL}, side as (select distinct g."row", g.col from grid g join star on least(x1, x2) <= col + 1 and greatest(x1, x2) >= col and least(y1, y2) <= "row" + 1 and greatest(y1, y2) >= "row"
 and abs((x2 - x1) * ("row" + 0.5 - y1) - (y2 - y1) * (col + 0.5 - x1)) <= (abs(x2 - x1) + abs(y2 - y1)) / 2)
select "row", col from side union {_RAY.format(crop="")}""")
def pixel_touch_polygons(spark, sf_dir):
    """Pixels whose square meets a field, slanted sides and corners included."""
    return scanline.touched(grid(spark, sf_dir), stars(spark, sf_dir))


@query(f'with {GRID_SQL} select "row", col from grid where {_touch_sql(_BOXES)}')
def pixel_touch_join(spark, sf_dir):
    return scanline.touched(grid(spark, sf_dir), polygons(spark, _BOXES))


@query(f"""with {GRID_SQL}, {_edges_sql("aoi", _AOI)}, {_edges_sql("val", _VALIDATION)}, a as ({_inside_sql("aoi", "grid")}), v as ({_inside_sql("val", "grid")})
select "row", col, "class" from grid where ("row", col) in (select "row", col from a) and ("row", col) not in (select "row", col from v) and "class" <> 255""")
def inside_mask_outside_anti(spark, sf_dir):
    df = grid(spark, sf_dir).where("class <> 255")
    aoi = scanline.within(df, polygons(spark, _AOI))
    return scanline.within(aoi, polygons(spark, _VALIDATION), outside=True).select("row", "col", "class")


_GOLDEN = [("cotton", [(2.1, 2.1), (7.9, 2.1), (7.9, 7.9), (2.1, 7.9)]), ("rice", [(12.1, 12.1), (17.9, 12.1), (17.9, 17.9), (12.1, 17.9)]), ("sugarcane", [(15.1, 12.1), (19.9, 12.1), (19.9, 17.9), (15.1, 17.9)])]
_ERODED = """select {g} "row" + dr "row", col + dc col from {t}, (select unnest([-1, 0, 1]) dr) a, (select unnest([-1, 0, 1]) dc) b group by all having count(*) = 9"""


@query(f"""with px as (select r::int "row", c::int col from range(20) a(r), range(20) b(c)), {_edges_sql("gold", _GOLDEN)}, cl as ({_inside_sql("gold", "px")}), er as ({_ERODED.format(g="crop,", t="cl")}),
one as (select "row", col, min(crop) crop from er group by all having count(*) = 1) select one.crop, count(*) n, r_name from one, region group by all""")
def burn_erode_ambiguity(spark, sf_dir):
    """The hand-countable raster of 20 by 20, once for each region."""
    px = spark.range(400).select(F.expr("cast(id div 20 as int)").alias("row"), (F.col("id") % 20).cast("int").alias("col"))
    claims = r.eroded(scanline.burn(px, polygons(spark, _GOLDEN)), "crop")
    counts = r.unambiguous(claims, *KEYS).groupBy("crop").agg(F.count(F.lit(1)).alias("n"))
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name")
    return regions.join(F.broadcast(counts), F.lit(True)).select("crop", "n", "r_name")


@query(f"""with {GRID_SQL}, m as (select "row", col from grid where size <= 45) {_ERODED.format(g="", t="m")}""")
def erosion_grid(spark, sf_dir):
    return r.eroded(grid(spark, sf_dir).where("size <= 45")).select("row", "col")


@query(f"""with recursive {GRID_SQL}, m as (select "row", col, "row"::bigint * 4294967296 + col node from grid where "class" = 1),
l as (select a.node u, b.node v from m a join m b on abs(a."row" - b."row") + abs(a.col - b.col) = 1),
reach as (select node, node root from m union select l.v, reach.root from reach join l on l.u = reach.node),
c as (select node, min(root) comp from reach group by node), s as (select comp, count(*) size from c group by comp)
select m."row", m.col, c.comp, s.size, s.size < 5 removed from m join c using (node) join s using (comp)""")
def sieve_components(spark, sf_dir):
    return r.sieved(grid(spark, sf_dir).where("class = 1"), 5)


_SIEVE_AOI = "col < 36"


@query(f"""with {GRID_SQL}, m as (select *, ({_touch_sql(_BOXES)}) and "class" = 1 hit from grid), s as (select count(*) filter ("class" = 1) b, count(*) filter (hit) rm from m where {_SIEVE_AOI})
select round(b * {PIXEL_ACRES}::double, 6) before, round(rm * {PIXEL_ACRES}::double, 6) removed, round((b - rm) * {PIXEL_ACRES}::double, 6) "after", round(coalesce(100.0::double * rm / nullif(b, 0), 0), 6) removed_pct from s""")
def mask_erase_stats(spark, sf_dir):
    g = grid(spark, sf_dir)
    marked = r.erased(g, scanline.touched(g, polygons(spark, _BOXES)), 1, 4, *KEYS)
    stats = r.erase_stats(marked, F.expr(_SIEVE_AOI), 1, PIXEL_ACRES)
    return stats.select(*(F.round(c, 6).alias(c) for c in stats.columns))


@query(f"""with {GRID_SQL}, {_EDGES}, {_BURNED}, mp as (select * from grid where "class" <> 255), t as (select 100.0::double * count(*) filter ("class" = 1) / greatest(count(*), 1) map_pct from mp)
select crop, count(*) ref_pixels, round(count(*) * {PIXEL_ACRES}::double, 6) ref_acres, count(*) filter ("class" = 1) mapped, round(100.0::double * count(*) filter ("class" = 1) / count(*), 6) pct_mapped, round(max(map_pct), 6) map_pct
from burned join mp using ("row", col), t group by crop""")
def raster_scores(spark, sf_dir):
    g = grid(spark, sf_dir)
    got = r.scored(g, scanline.burn(g, polygons(spark)), 1, 255, PIXEL_ACRES, *KEYS)
    return got.select("crop", "ref_pixels", *(F.round(c, 6).alias(c) for c in ("ref_acres", "pct_mapped", "map_pct")), "mapped")


@query(f"""with {GRID_SQL}, t as (select 0 rank, "row", col, "class" from grid where col < 30 union all select 1, "row", col, 4 from grid where col >= 20)
select "row", col, "class" from (select *, row_number() over (partition by "row", col order by rank) k from t) where k = 1""")
def mosaic_merge(spark, sf_dir):
    g = grid(spark, sf_dir).select("row", "col", "class")
    return r.mosaic([g.where("col < 30"), g.where("col >= 20").withColumn("class", F.lit(4))], *KEYS)
