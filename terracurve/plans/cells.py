"""Queries on cells and their selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import selection as sel
from ..sources.adapters import POINTS_SQL, points, read
from .registry import query

#: Market segments stand for the five classes.
SEGMENTS = {"AUTOMOBILE": "cotton", "BUILDING": "rice", "FURNITURE": "sugarcane", "HOUSEHOLD": "fall_maize", "MACHINERY": "orchard"}
CLASSES = list(SEGMENTS.values())
_R6 = lambda c: F.round(c, 6).alias(c)

_WIDE_SQL = POINTS_SQL + ", wide as (select i, j, " + ", ".join(f"coalesce(sum(acres) filter (\"class\" = '{s}'), 0)::double {c}" for s, c in SEGMENTS.items()) + " from pts group by i, j)"
_SAT = "sqrt(least({c}, 400) / 400)"
_SCORE = "1.5::double * " + _SAT.format(c="cotton") + " + " + " + ".join(_SAT.format(c=c) for c in CLASSES[1:])
_SHORT_SQL = _WIDE_SQL + f", short as (select *, {_SCORE} score from wide where cotton >= 60 order by score desc, i, j limit 60)"


def wide_cells(spark, sf_dir):
    """i, j and acres of each class."""
    by = points(spark, sf_dir).groupBy("i", "j").pivot("class", list(SEGMENTS)).agg(F.sum("acres"))
    return by.select("i", "j", *(F.coalesce(F.col(s), F.lit(0.0)).alias(c) for s, c in SEGMENTS.items()))


def short_cells(spark, sf_dir):
    return sel.shortlist(wide_cells(spark, sf_dir).where(F.col("cotton") >= sel.LEAST_COTTON), sel.score(CLASSES))


@query(f"with {POINTS_SQL} select id, i, j, printf('cell_%04d_%04d', i, j) cell_id, round((i + 0.5) * 0.1::double, 6) lon, round((j + 0.5) * 0.1::double, 6) lat from pts")
def cell_binning_centres(spark, sf_dir):
    df = points(spark, sf_dir).select("id", "i", "j", F.format_string("cell_%04d_%04d", "i", "j").alias("cell_id"))
    return df.select("*", F.round(geo.cell_centre(F.col("i")), 6).alias("lon"), F.round(geo.cell_centre(F.col("j")), 6).alias("lat"))


@query(f"with {_WIDE_SQL} select i, j, " + ", ".join(f"round({c}, 6) {c}" for c in CLASSES) + " from wide")
def cell_class_acres(spark, sf_dir):
    return wide_cells(spark, sf_dir).select("i", "j", *map(_R6, CLASSES))


# rank, west, south, east, north
_REGIONS = [(0, 66.0, 27.9, 66.55, 29.1), (1, 66.45, 27.9, 66.95, 28.6), (2, 66.45, 28.4, 67.2, 29.1)]
_REGION_SQL = "rg(rank, x0, y0, x1, y1) as (values " + ", ".join(f"({r}, {a}::double, {b}::double, {c}::double, {d}::double)" for r, a, b, c, d in _REGIONS) + ")"


@query(f"""with {POINTS_SQL}, {_REGION_SQL}, m as (select p.*, rank from pts p join rg on lon >= x0 and lon < x1 and lat >= y0 and lat < y1),
f as (select *, min(rank) over (partition by "class", i, j) f, min(rank) over (partition by "class", i, j, id) o from m)
select "class", i, j, round(sum(acres) filter (rank = f), 6) first_acres, round(sum(acres) filter (rank = o), 6) all_acres from f group by "class", i, j""")
def first_region_wins(spark, sf_dir):
    boxes = spark.createDataFrame(_REGIONS, "rank int, x0 double, y0 double, x1 double, y1 double")
    met = points(spark, sf_dir).join(F.broadcast(boxes), F.expr("lon >= x0 and lon < x1 and lat >= y0 and lat < y1"))
    return sel.first_region_acres(met, "class", "i", "j").select("class", "i", "j", _R6("first_acres"), _R6("all_acres"))


@query(f"""with {POINTS_SQL}, n as (select i, j, district, count(*) n from pts where acres > 0 group by all), m as (select *, row_number() over (partition by i, j order by n desc, district) r from n)
select c.i, c.j, coalesce(m.district, '') district from (select distinct i, j from pts) c left join m on m.i = c.i and m.j = c.j and r = 1""")
def district_mode(spark, sf_dir):
    p = points(spark, sf_dir)
    mode = p.where("acres > 0").groupBy("i", "j").agg(F.mode("district", True).alias("district"))
    return p.select("i", "j").distinct().join(mode, ["i", "j"], "left").select("i", "j", F.coalesce("district", F.lit("")).alias("district"))


@query(f"with {POINTS_SQL} select id, case when trim(province) in ('AFRICA', 'ASIA') then province when lat < 28.5::double then 'Sindh' else 'Punjab' end province from pts")
def province_resolution(spark, sf_dir):
    known = F.trim(F.coalesce("province", F.lit("")))
    by_lat = F.when(F.col("lat") < sel.SOUTH_LAT, "Sindh").otherwise("Punjab")
    return points(spark, sf_dir).select("id", F.when(known.isin("AFRICA", "ASIA"), known).otherwise(by_lat).alias("province"))


@query(f"""with {_SHORT_SQL}, neg as (select i, j, {_SAT.format(c="rice")} + {_SAT.format(c="fall_maize")} score from wide where rice + fall_maize >= 200),
a as (select *, row_number() over (order by score desc, i, j) place from neg), t as (select * from a where place <= 40),
s as (select *, 40 + row_number() over (order by score desc, i, j) place2 from neg where (j + 0.5) * 0.1::double < 28.0::double)
select 'cotton' list, i, j, (row_number() over (order by score desc, i, j))::int place, round(score, 6) score from short
union all select 'negative', i, j, place::int, round(score, 6) from t
union all select 'negative', i, j, place2::int, round(score, 6) from s where place2 <= 60 and (i, j) not in (select i, j from t)""")
def cell_score_topk(spark, sf_dir):
    from pyspark.sql import Window

    short = short_cells(spark, sf_dir)  # at most 60 rows
    order = Window.orderBy(F.col("score").desc(), "i", "j")
    a = short.select(F.lit("cotton").alias("list"), "i", "j", F.row_number().over(order).alias("place"), _R6("score"))
    neg = wide_cells(spark, sf_dir).where("rice + fall_maize >= 200").select("i", "j", sel.negative_score().alias("score"))
    b = sel.two_lists(neg, "score", geo.cell_centre(F.col("j")) < 28.0, 40, 20)
    return a.unionByName(b.select(F.lit("negative").alias("list"), "i", "j", "place", _R6("score")))


_LEAKS = [("val_a", 66.31, 28.02, 66.49, 28.21), ("val_b", 66.8, 28.7, 66.9, 28.88)]
_LEAK_SQL = " or ".join(f"(i * 0.1::double < {c + 0.02!r}::double and (i + 1) * 0.1::double > {a - 0.02!r}::double and j * 0.1::double < {d + 0.02!r}::double and (j + 1) * 0.1::double > {b - 0.02!r}::double)" for _, a, b, c, d in _LEAKS)


@query(f"with {_WIDE_SQL} select i, j from wide where not ({_LEAK_SQL})")
def leak_exclusion(spark, sf_dir):
    cells = wide_cells(spark, sf_dir).select("i", "j", *(F.expr(e).alias(n) for e, n in (("i * 0.1d", "c_xmin"), ("(i + 1) * 0.1d", "c_xmax"), ("j * 0.1d", "c_ymin"), ("(j + 1) * 0.1d", "c_ymax"))))
    boxes = spark.createDataFrame([(n, a, b, c, d) for n, a, b, c, d in _LEAKS], "name string, v_xmin double, v_ymin double, v_xmax double, v_ymax double")
    return cells.join(F.broadcast(boxes), geo.boxes_meet("c_", "v_", 0.02), "left_anti").select("i", "j")


@query("""with b as (select s_suppkey id, 66.0::double + (s_suppkey * 31 % 100) / 100.0::double x0, 28.0::double + (s_suppkey * 57 % 100) / 100.0::double y0, 0.05::double + (s_suppkey % 7) * 0.03::double w, 0.04::double + (s_suppkey % 5) * 0.04::double h from supplier),
c as (select *, unnest(range(floor(x0 / 0.1::double)::bigint, floor((x0 + w) / 0.1::double)::bigint + 1)) i from b), d as (select *, unnest(range(floor(y0 / 0.1::double)::bigint, floor((y0 + h) / 0.1::double)::bigint + 1)) j from c),
a as (select id, i, j, greatest(least(x0 + w, (i + 1) * 0.1::double) - greatest(x0, i * 0.1::double), 0) * greatest(least(y0 + h, (j + 1) * 0.1::double) - greatest(y0, j * 0.1::double), 0) area from d)
select id, i, j, round(area, 6) area from a where round(area, 6) > 0""")
def clip_area_to_cell(spark, sf_dir):
    key = F.col("s_suppkey")
    b = read(spark, sf_dir, "supplier").select(key.alias("id"), (66.0 + (key * 31 % 100) / 100.0).alias("x0"), (28.0 + (key * 57 % 100) / 100.0).alias("y0"), (0.05 + (key % 7) * 0.03).alias("w"), (0.04 + (key % 5) * 0.04).alias("h"))
    b = b.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h"))
    d = b.withColumn("i", F.explode(F.sequence(geo.cell(F.col("x0")), geo.cell(F.col("x1"))))).withColumn("j", F.explode(F.sequence(geo.cell(F.col("y0")), geo.cell(F.col("y1")))))
    xs, ys = F.array("x0", "x1", "x1", "x0"), F.array("y0", "y0", "y1", "y1")
    area = geo.clipped_area(xs, ys, F.col("i") * 0.1, F.col("j") * 0.1, (F.col("i") + 1) * 0.1, (F.col("j") + 1) * 0.1)
    return d.select("id", "i", "j", F.round(area, 6).alias("area")).where("area > 0")


def _chosen(spark, sf_dir):
    """The selected cells, at most 16, from a shortlist of at most 60 that the driver reads."""
    rows = [r.asDict() | {"south": (r["j"] + 0.5) * 0.1 < sel.SOUTH_LAT} for r in short_cells(spark, sf_dir).collect()]
    rows.sort(key=lambda c: (-c["score"], c["i"], c["j"]))
    return sel.chosen_by(sel.CELL_RULES, rows)


_GREEDY_SQL = _SHORT_SQL.replace("with ", "") + """, cand as (select (row_number() over (order by score desc, i, j) - 1)::int r, i, j, score, (j + 0.5) * 0.1::double < 28.5::double south from short),
nn as (select count(*)::int n from cand),
st(t, ci, cj, ns) as (select 0, []::bigint[], []::bigint[], 0 union all
 select t + 1, case when ok then list_append(ci, i) else ci end, case when ok then list_append(cj, j) else cj end, ns + (ok and south)::int from
 (select st.*, c.i, c.j, c.south, len(list_filter(range(1, len(ci) + 1), lambda k: greatest(abs(ci[k] - c.i), abs(cj[k] - c.j)) < 3 - (t // n) % 3)) = 0
   and case when t // n < 3 then c.south and len(ci) < 5 else len(ci) < 16 and not (c.south and ns >= 8) end ok
  from st, nn, cand c where c.r = t % n and t < 6 * n) x),
fin as (select ci, cj from st order by t desc limit 1),
chosen as (select unnest(ci) i, unnest(cj) j, unnest(range(1, len(ci) + 1))::int place from fin)"""


@query(f"with recursive {_GREEDY_SQL} select i, j, place from chosen")
def greedy_separated(spark, sf_dir):
    return spark.createDataFrame([(c["i"], c["j"], n) for n, c in enumerate(_chosen(spark, sf_dir), 1)], "i long, j long, place int")


# The state of the recursion is the list of the pilot's places: six steps that add one, then one for each required class.
_PILOT_SQL = _GREEDY_SQL + f""",
pc as (select place, i, j, score, (j + 0.5) * 0.1::double < {sel.SOUTH_LAT}::double south, list_filter([{", ".join(f"case when {c} > 0 then '{c}' end" for c in sel.REQUIRED)}], lambda x: x is not null) has from chosen join short using (i, j)),
pl as (select list(has order by place) hs, list(south order by place) ss, list(score order by place) sc from pc),
ps(t, pilot) as (select 0, []::int[] union all
 select t + 1, case when t < {sel.PILOT} then list_append(any_value(pilot), arg_max(place, (fits, gain, score, -place)))
  when max(gain) > 0 then list_append(list_filter(any_value(pilot), lambda p: p <> any_value(lowest)), arg_max(place, (gain, score, -place))) else any_value(pilot) end
 from (select *, case when t < {sel.PILOT} then len(list_filter(has, lambda x: not list_contains(flatten(list_transform(pilot, lambda p: hs[p])), x)))
    else (list_contains(has, want) and not list_contains(flatten(list_transform(pilot, lambda p: hs[p])), want))::int end gain,
   case when ns >= {sel.PILOT_SOUTH[1]} then not south when {sel.PILOT_SOUTH[0]} - ns >= {sel.PILOT} - len(pilot) then south else true end fits
  from (select ps.*, pc.*, pl.*, {list(sel.REQUIRED)!r}[t - {sel.PILOT - 1}] want, len(list_filter(pilot, lambda p: ss[p])) ns,
    list_sort(list_transform(pilot, lambda p: {{'s': sc[p], 'p': p}}))[1].p lowest from ps, pc, pl where t < {sel.PILOT + len(sel.REQUIRED)} and not list_contains(pilot, pc.place)) a) b group by t),
pilot as (select unnest(pilot) place from ps where t = (select max(t) from ps)),
batches as (select case when place in (select place from pilot) then 'pilot' else 'extension' end batch, pc.* from pc where (select count(*) from pc) >= {sel.PILOT})"""


def _batches(spark, sf_dir):
    rows = [(n, c["i"], c["j"], c["score"], c["south"], *(float(c[k]) for k in CLASSES)) for n, c in enumerate(_chosen(spark, sf_dir), 1)]
    return sel.pilot_and_rest(spark.createDataFrame(rows, "place int, i long, j long, score double, south boolean, " + ", ".join(f"{c} double" for c in CLASSES)))


@query(f"with recursive {_PILOT_SQL} select batch, i, j, round(b.score, 6) score, ({' + '.join(f'({c} > 0)::int' for c in CLASSES)})::int n_classes from batches b join wide using (i, j)")
def pilot_batch_split(spark, sf_dir):
    """The chosen cells in two batches."""
    n = F.size(F.filter(F.array(*CLASSES), lambda x: x > 0))
    return _batches(spark, sf_dir).select("batch", "i", "j", _R6("score"), n.alias("n_classes"))


@query(f"with recursive {_PILOT_SQL} select batch, count(*) cells, count(*) filter (south) southern, " + ", ".join(f"round(sum({c}), 6) {c}" for c in CLASSES) + " from batches join wide using (i, j) group by batch")
def batch_report(spark, sf_dir):
    """Cells and acres of the pilot and of the extension."""
    by = _batches(spark, sf_dir).groupBy("batch")
    return by.agg(F.count(F.lit(1)).alias("cells"), F.count_if("south").alias("southern"), *(F.round(F.sum(c), 6).alias(c) for c in CLASSES))


@query(f"with recursive {_GREEDY_SQL} select case when place <= 6 then 'first' else 'later' end batch, count(*) cells, " + ", ".join(f"round(sum({c}), 6) {c}" for c in CLASSES) + " from chosen join wide using (i, j) group by 1")
def batch_totals(spark, sf_dir):
    rows = [("first" if n <= 6 else "later", *(float(c[k]) for k in CLASSES)) for n, c in enumerate(_chosen(spark, sf_dir), 1)]
    df = spark.createDataFrame(rows, "batch string, " + ", ".join(f"{c} double" for c in CLASSES))
    return df.groupBy("batch").agg(F.count(F.lit(1)).alias("cells"), *(F.round(F.sum(c), 6).alias(c) for c in CLASSES))


@query(f"""with {POINTS_SQL} select "class", floor(lon / 0.5::double)::bigint bi, floor(lat / 0.5::double)::bigint bj, count(*) n, count(distinct (i, j)) cells, round(sum(acres), 6) acres from pts group by all""")
def chunk_ownership(spark, sf_dir):
    df = points(spark, sf_dir).withColumn("bi", geo.cell(F.col("lon"), 0.5)).withColumn("bj", geo.cell(F.col("lat"), 0.5))
    return df.groupBy("class", "bi", "bj").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i", "j").alias("cells"), F.round(F.sum("acres"), 6).alias("acres"))
