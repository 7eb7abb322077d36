"""The supplied tables as curves, pixels, polygons and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curve import normalized_difference

AXIS_FIRST, AXIS_BEGIN, AXIS_END, N_DATES, STEP = "1997-04-01", "1997-03-24", "1997-12-29", 35, 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, k, end_date, red, nir, nd: eight-day sums of each supplier's lines; slots without lines are absent."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    at = F.col("l_shipdate")
    lines = lines.where((at >= F.lit(AXIS_BEGIN).cast("timestamp_ntz")) & (at < F.lit(AXIS_END).cast("timestamp_ntz")))
    k = F.expr(f"datediff(cast(l_shipdate as date), date'{AXIS_BEGIN}') div {STEP} + 1").cast("int")
    red = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    nir = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
    sums = lines.groupBy(F.col("l_suppkey").alias("entity"), k.alias("k")).agg(F.sum(red).alias("red"), F.sum(nir).alias("nir"))
    end = F.date_add(F.lit(AXIS_FIRST).cast("date"), (F.col("k") - 1) * STEP)
    return sums.select("entity", "k", end.alias("end_date"), "red", "nir", normalized_difference(F.col("nir"), F.col("red")).alias("nd"))


def ts_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, curve: 35 values, null where missing."""
    values = F.map_from_entries(F.collect_list(F.struct("k", "nd")))
    by = ts_curves(spark, sf_dir).groupBy("entity").agg(values.alias("m"))
    return by.select("entity", F.transform(F.sequence(F.lit(1), F.lit(N_DATES)), lambda k: F.col("m")[k]).alias("curve"))


def vec_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, tile, aoi, curve."""
    df = read(spark, sf_dir, "embeddings")
    return df.select("vec_id", "label", (F.col("vec_id") % 12).alias("tile"), (F.col("vec_id") % 5).alias("aoi"), F.col("embedding").cast("array<double>").alias("curve"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat, class, acres, district, province, and the 0.1 degree cell i, j."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key = F.col("c_custkey")
    lon = F.lit(66.0) + (key * 7919 % 1000) / F.lit(1000.0) * 1.2
    lat = F.lit(27.9) + (key * 104729 % 1000) / F.lit(1000.0) * 1.2
    df = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    df = df.select(key.alias("id"), lon.alias("lon"), lat.alias("lat"), F.col("c_mktsegment").alias("class"), (F.greatest("c_acctbal", F.lit(0.0)) / 50).alias("acres"), F.col("n_name").alias("district"), F.col("r_name").alias("province"))
    return df.withColumn("i", F.floor(F.col("lon") / 0.1)).withColumn("j", F.floor(F.col("lat") / 0.1))


POINTS_SQL = """points as (select c_custkey id, 66.0::double + (c_custkey * 7919 % 1000) / 1000.0::double * 1.2::double lon, 27.9::double + (c_custkey * 104729 % 1000) / 1000.0::double * 1.2::double lat,
 c_mktsegment "class", greatest(c_acctbal, 0) / 50 acres, n_name district, r_name province from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
pts as (select *, floor(lon / 0.1::double)::bigint i, floor(lat / 0.1::double)::bigint j from points)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, class (1, 4, 255) and size of the pixel grid."""
    p = read(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") <= 22, 1).when(F.col("p_size") == 50, 255).otherwise(4)
    return p.select(F.expr("p_partkey div 50").cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), kind.alias("class"), F.col("p_size").alias("size"))


GRID_SQL = """grid as (select (p_partkey // 50)::int "row", (p_partkey % 50)::int col, case when p_size <= 22 then 1 when p_size = 50 then 255 else 4 end "class", p_size size from part)"""
#: crop, vertices (x, y); pixels have centres at col + 0.5, row + 0.5.
POLYGONS = [
    ("cotton", [(2, 2), (20, 2), (20, 16), (2, 16)]),
    ("rice", [(14, 10), (32, 10), (32, 24), (14, 24)]),
    ("sugarcane", [(18, 12), (40, 12), (40, 20), (18, 20)]),
    ("fall_maize", [(5, 26), (25, 26), (15, 38)]),
    ("orchard", [(30, 26), (46, 26), (46, 38), (30, 38)]),
]


def polygons(spark: SparkSession, shapes=POLYGONS) -> DataFrame:
    """id, crop, xs, ys and bounding box."""
    rows = [(n, c, [float(x) for x, _ in v], [float(y) for _, y in v]) for n, (c, v) in enumerate(shapes)]
    df = spark.createDataFrame(rows, "id int, crop string, xs array<double>, ys array<double>")
    return df.select("*", F.array_min("xs").alias("xmin"), F.array_max("xs").alias("xmax"), F.array_min("ys").alias("ymin"), F.array_max("ys").alias("ymax"))


#: Crops of the fields of ``stars``, and the directions of their corners.
CROPS = ["cotton", "rice", "sugarcane", "fall_maize", "orchard"]
_AROUND = [(5, 0), (3, 4), (0, 5), (-4, 3), (-5, 0), (-3, -4), (0, -5), (4, -3)]


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, crop, xs, ys: fields of eight corners, few of them convex, in the pixels of ``grid``; one for each supplier."""
    k = F.col("s_suppkey")
    x, y = 3.137 + (k * 37 % 45), 0.291 + k * 0.4
    far = lambda j: (1 + (k * ((j + 3) * 7) + j * j) % 9) / 4.0
    at = lambda c, i: F.array(*(c + v[i] * far(j) for j, v in enumerate(_AROUND)))
    crop = F.element_at(F.array(*map(F.lit, CROPS)), (k % 5 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(k.alias("id"), crop.alias("crop"), at(x, 0).alias("xs"), at(y, 1).alias("ys"))


STARS_SQL = f"""around(j, dx, dy) as (values {", ".join(f"({j}, {x}, {y})" for j, (x, y) in enumerate(_AROUND))}),
corner as (select s_suppkey id, {CROPS!r}[1 + s_suppkey % 5] crop, j, 3.137::double + (s_suppkey * 37 % 45) + dx * ((1 + (s_suppkey * ((j + 3) * 7) + j * j) % 9) / 4.0::double) x,
 0.291::double + s_suppkey * 0.4::double + dy * ((1 + (s_suppkey * ((j + 3) * 7) + j * j) % 9) / 4.0::double) y from supplier, around),
star as (select a.id, a.crop, a.j, a.x x1, a.y y1, b.x x2, b.y y2 from corner a join corner b on a.id = b.id and b.j = (a.j + 1) % {len(_AROUND)})"""
TS_SQL = """ts as (select l_suppkey entity, ((l_shipdate::date - date '1997-03-24') // 8 + 1)::int k, sum(case when l_returnflag = 'R' then l_quantity else 0 end)::double red,
 sum(case when l_returnflag <> 'R' then l_quantity else 0 end)::double nir from lineitem where l_shipdate >= timestamp '1997-03-24' and l_shipdate < timestamp '1997-12-29' group by all),
nd as (select entity, k, date '1997-04-01' + (k - 1) * 8 end_date, red, nir, case when nir + red > 0 then (nir - red) / (nir + red) end nd from ts)"""
VEC_SQL = """e as (select vec_id, label, vec_id % 12 tile, vec_id % 5 aoi, unnest(range(len(embedding)))::int pos, unnest(embedding)::double x from embeddings)"""
PROFILE_SQL = VEC_SQL + """,
med as (select label cls, pos, median(x) m from e group by all),
dist as (select vec_id, label, tile, aoi, cls, avg(abs(x - m)) d from e join med using (pos) group by all)"""
