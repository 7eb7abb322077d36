"""Queries on stored features, tiles that may be broken, a stream of files, and a saved model's card."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from ..functions.geo import area
from ..operators import learning as ml
from ..schema import CODES, DATES, ContractError
from ..session import scratch
from ..sources import io, lattice, probe
from ..sources.adapters import GRID_SQL, STARS_SQL, grid, read, stars, vec_curves
from ..streaming.composite import composite_files
from .registry import query

_SIDE = 16.0
_CENTRE_SQL = """c as (select id, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) x, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) y, abs(sum(x1 * y2 - x2 * y1)) / 2 a,
 min(x1) xmin, min(y1) ymin, max(x1) xmax, max(y1) ymax from star group by id)"""


@query(f"""with {STARS_SQL}, {_CENTRE_SQL}, b as (select distinct floor((p_partkey % 50) / {_SIDE}::double)::bigint bi, floor((p_partkey // 50) / {_SIDE}::double)::bigint bj from part where p_size = 17)
select floor(x / {_SIDE}::double)::bigint bi, floor(y / {_SIDE}::double)::bigint bj, count(*) n, round(sum(a), 5) area from c where (floor(x / {_SIDE}::double)::bigint, floor(y / {_SIDE}::double)::bigint) in (select (bi, bj) from b) group by 1, 2""")
def lattice_walk(spark, sf_dir):
    """Fields and their area by block, for the blocks that hold a part of one size; the other partitions aren't read."""
    path = scratch(spark, "lattice")
    lattice.write_lattice(stars(spark, sf_dir), path, _SIDE)
    p = read(spark, sf_dir, "part").where("p_size = 17")
    blocks = p.select(F.floor((F.col("p_partkey") % 50) / _SIDE).alias("bi"), F.floor(F.expr("p_partkey div 50") / _SIDE).alias("bj"))
    got = lattice.walked(spark, path, blocks, _SIDE)
    by = got.groupBy(F.col("bi").cast("long").alias("bi"), F.col("bj").cast("long").alias("bj"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(area(F.col("xs"), F.col("ys"))), 5).alias("area"))


_WINDOW = (10.0, 4.0, 35.0, 25.0)


@query(f"""with {STARS_SQL}, {_CENTRE_SQL} select id, round(a, 6) area from c where xmax >= {_WINDOW[0]} and ymax >= {_WINDOW[1]} and xmin <= {_WINDOW[2]} and ymin <= {_WINDOW[3]}""")
def vector_window(spark, sf_dir):
    """Fields stored along a curve, and those that meet a window read again."""
    path = scratch(spark, "curve")
    lattice.write_along_curve(stars(spark, sf_dir), path)
    got = io.scan_boxed(spark, path, _WINDOW, ["id", "xs", "ys"])
    return got.select("id", F.round(area(F.col("xs"), F.col("ys")), 6).alias("area"))


@query(f"with {STARS_SQL} select min(x1) xmin, min(y1) ymin, max(x1) xmax, max(y1) ymax from star")
def vector_extent(spark, sf_dir):
    """Bounds of the stored fields, from footers alone."""
    path = scratch(spark, "extent")
    lattice.write_along_curve(stars(spark, sf_dir), path)
    return lattice.stored_extent(spark, path)


_FIRST, _LAST, _MONTHS = "1995-01-01", "1996-12-01", 24
_BANDS = StructType([StructField("date", DateType()), StructField("price", DoubleType()), StructField("n", LongType())])


def _tiles(spark, sf_dir):
    """tile, date, price, n: orders of a customer group by month; tile 5 lacks a year."""
    o = read(spark, sf_dir, "orders")
    by = o.groupBy((F.col("o_custkey") % 10).alias("tile"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date")).agg(F.sum("o_totalprice").cast("double").alias("price"), F.count(F.lit(1)).alias("n"))
    return by.where(~((F.col("tile") == 5) & (F.year("date") == 1996)))


@query(f"""with t as (select o_custkey % 10 tile, date_trunc('month', o_orderdate)::date d from orders group by all),
k as (select tile, count(*) filter (d between date '{_FIRST}' and date '{_LAST}' and not (tile = 5 and year(d) = 1996)) n from t where tile not in (3, 7) group by tile)
select x::varchar tile, coalesce(n, 0) n_dates, case when x = 3 then 'broken' when n is null then 'absent' when n <> {_MONTHS} then 'short' else 'complete' end status from range(12) r(x) left join k on k.tile = x""")
def tile_probe(spark, sf_dir):
    """Tiles written, one of them cut off afterwards and one not written, and what a later run finds."""
    path = scratch(spark, "tiles")
    io.write_tiles(_tiles(spark, sf_dir).where("tile <> 7").repartition("tile"), path)
    for r in probe.listing(spark, path).where("file like '%/tile=3/%'").collect():  # the files of one tile
        probe.cut_off(spark, r["file"])
    wanted = spark.range(12).select(F.col("id").cast("string").alias("tile"))
    return probe.probed(spark, path, wanted, _BANDS, _FIRST, _LAST, _MONTHS)


@query("select case when o_custkey % 10 = 1 then 'one' else 'two' end source, count(distinct date_trunc('month', o_orderdate)) n from orders where o_custkey % 10 in (1, 2) group by all")
def tolerant_sources(spark, sf_dir):
    """Rows of four sources, of which one is broken and one doesn't exist."""
    path, names = scratch(spark, "sources"), {"one": 1, "two": 2, "broken": 4}
    for name, tile in names.items():
        _tiles(spark, sf_dir).where(F.col("tile") == tile).drop("tile").coalesce(1).write.parquet(f"{path}/{name}")
    for r in probe.listing(spark, f"{path}/broken").collect():
        probe.cut_off(spark, r["file"])
    return probe.tolerant(spark, {n: f"{path}/{n}" for n in [*names, "nowhere"]}, _BANDS).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""with w as (select event_type, date_trunc('day', ts)::date + 1 end_date, count(value) n, avg(value) mean from events group by all)
select event_type, end_date, n, round(mean, 6) mean from w where end_date <= (select max(ts) - interval 1 day from events)""")
def stream_composite(spark, sf_dir):
    """Daily composites of a stream of files, over two runs: the second goes on where the first stopped."""
    events = read(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    into, out, state = (scratch(spark, n) for n in ("events", "composites", "state"))
    half = F.lit("2024-01-16").cast("timestamp")
    for part in (events.where(F.col("ts") < half), events.where(F.col("ts") >= half)):
        part.write.mode("append").parquet(into)
        composite_files(spark, into, events.schema, out, state, "ts", "value", "event_type", days=1, late="1 day")
    return spark.read.parquet(out).select("event_type", "end_date", "n", F.round("mean", 6).alias("mean"))


_CASES = ("same", "reordered", "date_missing", "date_more", "code_moved")


@query("select c.name, c.name <> 'same' refused, case when c.name = 'same' then (select count(*) from embeddings) else 0 end n from (values " + ", ".join(f"('{c}')" for c in _CASES) + ") c(name)")
def card_guard(spark, sf_dir):
    """What a model's saved card says of tables that come later, and the rows that may be predicted."""
    df = vec_curves(spark, sf_dir).select(*(F.get("curve", F.lit(i)).alias(d) for i, d in enumerate(DATES)))
    path = scratch(spark, "card")
    io.write_json(spark, {"dates": DATES, "codes": CODES}, path)
    card = io.read_json(spark, path)
    tables = {
        "same": (df, CODES), "reordered": (df.select(DATES[1], DATES[0], *DATES[2:]), CODES), "date_missing": (df.drop(DATES[20]), CODES),
        "date_more": (df.withColumn("2026-01-07", F.lit(0.5)), CODES), "code_moved": (df, CODES | {"rice": 3, "sugarcane": 2}),
    }
    rows = []
    for name in _CASES:
        case, codes = tables[name]
        try:
            rows.append((name, False, case.select(*ml.check_card(case.columns, codes, card)).count()))
        except ContractError:
            rows.append((name, True, 0))
    return spark.createDataFrame(rows, "name string, refused boolean, n long")


@query("""select year(o_orderdate)::int "year", 'orders_' || year(o_orderdate) stem, count(*) n, count(*) filter (year(o_orderdate) >= 1995 and o_orderpriority = '1-URGENT') urgent from orders group by all""")
def multi_file_scan(spark, sf_dir):
    """A file a year, of which the older ones lack a column, read as one table with the file's name as a key."""
    path = scratch(spark, "years")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"))
    for y in [r["year"] for r in o.select("year").distinct().collect()]:  # a handful of years
        part = o.where(F.col("year") == y)
        io.write_named(part if y >= 1995 else part.drop("priority"), f"{path}/orders_{y}__v1.parquet")
    got = io.scan_files(spark, f"{path}/*.parquet")
    by = got.groupBy("year", io.stem(F.col("file")).alias("stem"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("priority") == "1-URGENT").alias("urgent"))


_LINES = StructType([StructField("key", LongType()), StructField("price", DoubleType()), StructField("day", DateType())])


@query("""select case when o_orderkey % 5 = 0 then 'bad' else 'good' end kind, count(*) n, count(*) n_keys, round(sum(case when o_orderkey % 5 = 0 then 0 else o_totalprice end)::double, 2) price from orders group by all""")
def csv_with_bad_lines(spark, sf_dir):
    """Lines of which every fifth has a word where a number belongs."""
    path = scratch(spark, "lines")
    o = read(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(F.col("o_totalprice").cast("string"))
    o.select(F.col("o_orderkey").alias("key"), price.alias("price"), F.col("o_orderdate").cast("date").alias("day")).write.option("header", True).csv(path)
    got = io.scan_csv(spark, path, _LINES)
    by = got.groupBy(F.when(F.col("bad_record").isNotNull(), "bad").otherwise("good").alias("kind"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("n_keys"), F.round(F.coalesce(F.sum("price"), F.lit(0.0)), 2).alias("price"))


@query("""with o as (select year(o_orderdate) % 2 half, count(*) n from orders group by all) select 1 "read", n, 1 made from o where half = 1 union all select 2, n, 1 from o where half = 1 union all select 3, sum(n)::bigint, 2 from o""")
def cached_table(spark, sf_dir):
    """Rows behind a cache that is read twice and, after its source has grown, a third time; and how often it was made."""
    source, cache, made, rows = scratch(spark, "source"), scratch(spark, "cache"), [], []
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") % 2).alias("half"))

    def make():
        made.append(1)
        return spark.read.parquet(source)

    for n, more in enumerate((1, None, 0), 1):
        if more is not None:
            o.where(F.col("half") == more).write.mode("append").parquet(source)
        rows.append((n, io.cached_while(spark, cache, make, source).count(), len(made)))
    return spark.createDataFrame(rows, "read int, n long, made int")


_SOME = (3, 17, 10, 30)


@query(f"""with {GRID_SQL} select "row", col, "class", size, 'class,size' bands, 16 side, 'crops' title from grid where "row" between {_SOME[0]} and {_SOME[1]} and col between {_SOME[2]} and {_SOME[3]}""")
def raster_roundtrip(spark, sf_dir):
    """A raster written in blocks with its description, and a window of it read again."""
    path = scratch(spark, "raster")
    io.write_raster(grid(spark, sf_dir), path, 16, {"title": "crops", "nodata": 255})
    df, told = io.read_raster(spark, path, _SOME)
    return df.select("row", "col", "class", "size", F.lit(",".join(told["bands"])).alias("bands"), F.lit(told["side"]).alias("side"), F.lit(told["title"]).alias("title"))
