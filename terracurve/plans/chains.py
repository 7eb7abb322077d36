"""Queries that chain operators, and those on files, models and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curve as c
from ..functions import geo
from ..operators import learning as ml
from ..operators import profiles as p
from ..operators import sampling as s
from ..operators import selection as sel
from ..operators import tiles
from ..schema import ACRE_M2, CODES
from ..session import scratch
from ..sources import io, lattice
from ..sources.adapters import GRID_SQL, STARS_SQL, grid, polygons, read, stars, vec_curves
from .cells import _LEAK_SQL, _LEAKS, _SAT, _WIDE_SQL, wide_cells
from .curves import _NEAR_SQL, _R6, _SMOOTH_SQL, _rows_sql
from .learning import _set
from .pixels import _EDGES, _ERODED, _inside_sql
from .registry import query

BANDS, WINDOW, BLOCK = 40, (3, 35), 16
ORIGIN, STEP = (66.0, 29.0), (0.001, -0.001)


def tile_pixels(spark, sf_dir):
    """row, col, red, nir: bands made from the pixel's number; pixels of size 50 have none."""
    df = grid(spark, sf_dir).withColumn("_p", F.col("row") * 50 + F.col("col"))
    value = lambda a, b, m: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.when(F.col("size") != 50, (F.col("_p") * a + k * b) % m + 1.0))
    return df.select("row", "col", value(7, 3, 11).alias("red"), value(5, 13, 17).alias("nir"))


_CLAIMS_SQL = f"""{GRID_SQL}, {_EDGES}, cl as ({_inside_sql("edges", "grid")}), er as ({_ERODED.format(g="crop,", t="cl")}),
lb as (select "row", col, min(crop) crop from er group by all having count(*) = 1)"""


@query(f"""with {_CLAIMS_SQL}, {_SMOOTH_SQL.format(n=BANDS, m=_rows_sql(c.hat_matrix(BANDS)))},
bd as (select lb."row", lb.col, crop, k, ((lb."row" * 50 + lb.col) * 7 + k * 3) % 11 + 1.0::double red, ((lb."row" * 50 + lb.col) * 5 + k * 13) % 17 + 1.0::double nir from lb join grid using ("row", col), (select unnest(range({BANDS}))::int k) where size <> 50),
sm as (select "row", col, crop, o, sum(w * (nir - red) / (nir + red)) y from bd join hh on i = k where o between {WINDOW[0]} and {sum(WINDOW) - 1} group by all)
select "row", col, crop, case crop {" ".join(f"when '{k}' then {v}" for k, v in CODES.items())} end code, round(66.0::double + (col + 0.5::double) * 0.001::double, 6) lon, round(29.0::double - ("row" + 0.5::double) * 0.001::double, 6) lat, o - {WINDOW[0]} pos, 0::double + round(y, 6) value from sm""")
def tile_labelled_rows(spark, sf_dir):
    """A tile's pixels and polygons as labelled, smoothed, cut curves with their place on earth."""
    got = tiles.labelled_rows(tile_pixels(spark, sf_dir), polygons(spark), CODES, ORIGIN, STEP, WINDOW, lambda y: c.smooth_complete(y, BANDS))
    got = got.withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))
    return p.long_curves(got, "row", "col", "crop", "code", "lon", "lat").select("row", "col", "crop", "code", "lon", "lat", "pos", _R6(F.col("x"), "value"))


@query(f"""with {_CLAIMS_SQL}, bl as (select distinct "row" // {BLOCK} block_row, col // {BLOCK} block_col from lb)
select "row" // {BLOCK} block_row, col // {BLOCK} block_col, count(*) pixels from grid where ("row" // {BLOCK}, col // {BLOCK}) in (select block_row, block_col from bl) group by all""")
def labelled_blocks(spark, sf_dir):
    px = grid(spark, sf_dir).select("row", "col")
    got = tiles.in_labelled_blocks(px, tiles.labels_of(px, polygons(spark)), BLOCK)
    return got.groupBy("block_row", "block_col").agg(F.count(F.lit(1)).alias("pixels"))


@query(f"""with recursive {_WIDE_SQL}, neg as (select i, j, {_SAT.format(c="rice")} + {_SAT.format(c="fall_maize")} score from wide where rice + fall_maize >= 200 and not ({_LEAK_SQL})),
a as (select *, row_number() over (order by score desc, i, j) place from neg), t40 as (select * from a where place <= 40),
so as (select *, 40 + row_number() over (order by score desc, i, j) place from neg where (j + 0.5) * 0.1::double < 28.0::double),
un as (select * from t40 union all by name select * from so where place <= 60 and (i, j) not in (select i, j from t40)),
cand as (select (row_number() over (order by place) - 1)::int r, i, j, (j + 0.5) * 0.1::double < 28.5::double south from un), nn as (select count(*)::int n from cand),
st(t, ci, cj) as (select 0, []::bigint[], []::bigint[] union all
 select t + 1, case when ok then list_append(ci, i) else ci end, case when ok then list_append(cj, j) else cj end from
 (select st.*, c.i, c.j, len(list_filter(range(1, len(ci) + 1), lambda k: greatest(abs(ci[k] - c.i), abs(cj[k] - c.j)) < ([5, 5, 5, 3, 2])[t // n + 1])) = 0
   and case t // n when 0 then not c.south and len(ci) < 1 when 1 then c.south and len(ci) < 2 else len(ci) < 4 end ok from st, nn, cand c where c.r = t % n and t < 5 * n) x),
fin as (select ci, cj from st order by t desc limit 1)
select unnest(ci) i, unnest(cj) j, unnest(range(1, len(ci) + 1))::int place from fin""")
def negative_cells(spark, sf_dir):
    """Cells without the target: outside validation areas, one of the north and one of the south first. The driver sees the 60 candidates at most."""
    cells = wide_cells(spark, sf_dir).where("rice + fall_maize >= 200")
    cells = cells.select("*", *(F.expr(e).alias(n) for e, n in (("i * 0.1d", "c_xmin"), ("(i + 1) * 0.1d", "c_xmax"), ("j * 0.1d", "c_ymin"), ("(j + 1) * 0.1d", "c_ymax"))))
    boxes = spark.createDataFrame([(a, b, x, y) for _, a, b, x, y in _LEAKS], "v_xmin double, v_ymin double, v_xmax double, v_ymax double")
    cells = cells.join(F.broadcast(boxes), geo.boxes_meet("c_", "v_", 0.02), "left_anti").select("i", "j", sel.negative_score().alias("score"))
    found = sel.two_lists(cells, "score", geo.cell_centre(F.col("j")) < 28.0, 40, 20).collect()
    rows = [r.asDict() | {"south": (r["j"] + 0.5) * 0.1 < sel.SOUTH_LAT} for r in sorted(found, key=lambda r: r["place"])]
    return spark.createDataFrame([(r["i"], r["j"], n) for n, r in enumerate(sel.chosen_by(sel.negative_rules(), rows), 1)], "i long, j long, place int")


@query(f"""with {_NEAR_SQL}, ok as (select vec_id, tile from near where tile < 4 and nearest <> 1),
cp as (select * from (select *, row_number() over (partition by tile order by md5(vec_id::varchar || ':42'), vec_id::varchar) r from ok) where r <= 5)
select vec_id, 4 code, 'old_' || tile "group" from cp union all select vec_id, label, tile::varchar from near where tile >= 4""")
def generic_negatives(spark, sf_dir):
    """Older rows that don't look like the target, capped for each area after that, beside the new ones."""
    df = vec_curves(spark, sf_dir)
    old = p.drop_near(df.where("tile < 4"), p.median_profiles(df), 1).select("vec_id", "tile")
    old = s.cap(old, 5, F.col("vec_id").cast("string"), 42, "tile").select("vec_id", F.lit(4).alias("code"), F.concat(F.lit("old_"), "tile").alias("group"))
    return old.unionByName(df.where("tile >= 4").select("vec_id", F.col("label").alias("code"), F.col("tile").cast("string").alias("group")))


@query(f"""with t as (select s_suppkey id, 66.0::double + (s_suppkey * 31 % 100) / 100.0::double x0, 28.0::double + (s_suppkey * 57 % 100) / 100.0::double y0, 0.05::double + (s_suppkey % 7) * 0.03::double w, 0.04::double + (s_suppkey % 5) * 0.04::double h from supplier)
select id, round(w * h / 2 * {geo.metres2_per_degree2(28.5)!r}::double / {ACRE_M2}::double, 4) acres, round(x0 + w / 2, 6) lon, round(y0 + h / 3, 6) lat from t""")
def polygon_acres(spark, sf_dir):
    """Triangles cut by the cells they meet: the acres of all parts, and the centroid."""
    k = F.col("s_suppkey")
    t = read(spark, sf_dir, "supplier").select(k.alias("id"), (66.0 + (k * 31 % 100) / 100.0).alias("x0"), (28.0 + (k * 57 % 100) / 100.0).alias("y0"), (0.05 + (k % 7) * 0.03).alias("w"), (0.04 + (k % 5) * 0.04).alias("h"))
    t = t.select("id", F.expr("array(x0, x0 + w, x0 + w / 2)").alias("xs"), F.expr("array(y0, y0, y0 + h)").alias("ys"))
    lon, lat = geo.centroid(F.col("xs"), F.col("ys"))
    along = lambda v, name: F.explode(F.sequence(geo.cell(F.array_min(v)), geo.cell(F.array_max(v)))).alias(name)
    d = t.select("*", lon.alias("lon"), lat.alias("lat")).select("*", along("xs", "i")).select("*", along("ys", "j"))
    d = geo.clipped_to_box(d, F.col("i") * 0.1, F.col("j") * 0.1, (F.col("i") + 1) * 0.1, (F.col("j") + 1) * 0.1)
    by = d.withColumn("part", F.when(F.size("xs") > 2, geo.area(F.col("xs"), F.col("ys"))).otherwise(0.0)).groupBy("id").agg((F.sum("part") * geo.metres2_per_degree2(28.5) / ACRE_M2).alias("acres"), F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    return by.select("id", F.round("acres", 4).alias("acres"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("""with r as (select s_name || '__v' || s_suppkey % 3 slug, s_acctbal balance from supplier where s_suppkey % 4 <> 0), f as (select 'out/' || s_name || case when s_suppkey % 2 = 0 then '__b' else '' end || '.parquet' path from supplier where s_suppkey % 3 <> 0)
select split_part(slug, '__', 1) stem, slug, balance, path from r join f on split_part(slug, '__', 1) = split_part(regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', ''), '__', 1)""")
def run_file_join(spark, sf_dir):
    df = read(spark, sf_dir, "supplier")
    runs = df.where("s_suppkey % 4 <> 0").select(F.concat("s_name", F.lit("__v"), (F.col("s_suppkey") % 3).cast("string")).alias("slug"), F.col("s_acctbal").alias("balance"))
    tag = F.when(F.col("s_suppkey") % 2 == 0, "__b").otherwise("")
    return io.with_files(runs, df.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("out/"), "s_name", tag, F.lit(".parquet")).alias("path")))


@query("select * exclude (o_custkey, o_orderdate) from orders")
def complement_projection(spark, sf_dir):
    return io.without(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("select columns('^o_order.*') from orders")
def prefix_projection(spark, sf_dir):
    return io.with_prefix(read(spark, sf_dir, "orders"), "o_order")


@query("select p_partkey, p_brand from part where p_brand glob 'Brand#1?'")
def glob_match(spark, sf_dir):
    return read(spark, sf_dir, "part").where(io.matches_glob(F.col("p_brand"), "Brand#1?")).select("p_partkey", "p_brand")


_VECTORS = (10.0, 0.0, 35.0, 25.0)


@query(f"""with {STARS_SQL}, b as (select id, crop, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) area, min(x1) xmin, max(x1) xmax, min(y1) ymin, max(y1) ymax from star group by id, crop)
select id, crop, area from b where xmax >= {_VECTORS[0]} and ymax >= {_VECTORS[1]} and xmin <= {_VECTORS[2]} and ymin <= {_VECTORS[3]}""")
def vector_table(spark, sf_dir):
    """Fields written with their boxes, and those that meet a window read again."""
    path = scratch(spark, "vectors")
    io.write_vectors(lattice.boxed(stars(spark, sf_dir)), path)
    got = io.scan_boxed(spark, path, _VECTORS, ["id", "crop", "xs", "ys"])
    return got.select("id", "crop", F.round(geo.area(F.col("xs"), F.col("ys")), 6).alias("area"))


@query("""with b as (select o_custkey % 50 pixel, strftime(o_orderdate, '%Y_%m_01') d, sum(o_totalprice)::double v from orders group by all)
select pixel, (row_number() over (partition by pixel order by d) - 1)::int pos, round(v, 2) as "value" from b where d like '1995%'""")
def selected_bands(spark, sf_dir):
    """Bands of one year among others, in order of their dates, as curves."""
    at = F.date_format("o_orderdate", "yyyy_MM_01")
    name = F.concat(F.when(F.year("o_orderdate") == 1995, "ndvi_").otherwise("scl_"), at)
    bands = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("pixel"), name.alias("name")).agg(F.sum("o_totalprice").alias("v"))
    by = bands.groupBy("pixel").agg(c.bands_by_date(F.col("name"), F.col("v")).alias("curve"))
    return p.long_curves(by, "pixel").select("pixel", "pos", F.round("x", 2).alias("value"))


@query()
def rf_kfold_report(spark, sf_dir):
    """Macro F1 over three folds of rows: mean, least and greatest (10 trees of depth 6)."""
    f1 = ml.k_fold(_set(spark, sf_dir), F.col("vec_id"), trees=10, depth=6)
    return spark.createDataFrame([(len(f1), sum(f1) / len(f1), min(f1), max(f1))], "folds int, mean double, least double, greatest double")


@query()
def rf_saved_model(spark, sf_dir):
    """Predictions of a forest, of the same forest saved and loaded, and whether they agree."""
    path = scratch(spark, "forest")
    df = _set(spark, sf_dir)
    model = ml.fit(ml.balanced(df), trees=5, depth=5)
    ml.save(model, path)
    one = ml.predict(model, df).select("vec_id", "features", F.col("pred").alias("before"), F.col("p").alias("p0"))
    two = ml.predict(ml.load(path), one)
    return two.select("vec_id", "before", "pred", ((F.col("before") == F.col("pred")) & (F.col("p0") == F.col("p"))).alias("same"))


@query("""with t as (select count(distinct vec_id % 12) tiles from embeddings) select label::varchar code, count(*) n_rows, max(t.tiles) tiles, 64 dates, 'table' source from embeddings, t group by label""")
def model_card_file(spark, sf_dir):
    """The card written to the shared folder and read again; it names the real source of the rows."""
    path = scratch(spark, "card")
    df = vec_curves(spark, sf_dir).select("label", "tile")
    io.write_json(spark, ml.card(df, [f"step_{i:02d}" for i in range(64)], CODES, ml.DEFAULTS, "table"), path)
    card = io.read_json(spark, path)
    rows = [(k, n, len(card["tiles"]), len(card["dates"]), card["source"]) for k, n in card["rows_per_class"].items()]
    return spark.createDataFrame(rows, "code string, n_rows long, tiles long, dates int, source string")
