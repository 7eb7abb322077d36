"""Queries on curves: composites, smoothing, phenology, profiles."""

from __future__ import annotations

import calendar

from pyspark.sql import functions as F

from ..functions import curve as c
from ..operators import profiles as p
from ..operators.running import quantiles
from ..sources.adapters import AXIS_FIRST, N_DATES, PROFILE_SQL, TS_SQL, VEC_SQL, read, ts_arrays, ts_curves, vec_curves
from . import registry


def query(sql=None):
    """Adding zero on both sides turns a rounded -0.0 into 0.0."""
    return registry.query(sql and sql.replace("round(", "0::double + round("))


def _R6(x, name):
    return (F.round(x, 6) + F.lit(0.0)).alias(name)


_MONTHS = [m.lower() for m in calendar.month_abbr[4:]]


def _rows_sql(matrix) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in matrix) + "]::double[][]"


@query(f"with {TS_SQL} select k::bigint k, end_date, count(nd) n, round(median(nd), 6) med from nd group by all")
def profile_median_curve(spark, sf_dir):
    df = ts_curves(spark, sf_dir)
    by = df.groupBy("k", "end_date").agg(F.count("nd").alias("n")).join(quantiles(df, ["k", "end_date"], [0.5], "nd"), ["k", "end_date"], "left")
    return by.select(F.col("k").cast("long").alias("k"), "end_date", "n", _R6(F.col("q0"), "med"))


@query("select r_name, k::int k, date '1997-04-01' + ((k - 1) * 8)::int end_date from region, range(1, 36) t(k)")
def date_axis(spark, sf_dir):
    dates = F.posexplode(c.date_axis(AXIS_FIRST, N_DATES))
    return read(spark, sf_dir, "region").select("r_name", dates.alias("k", "end_date")).select("r_name", (F.col("k") + 1).alias("k"), "end_date")


@query(r"""
with b as (select distinct case when o_orderkey % 7 = 0 then 'scl_' else 'ndvi_' end || strftime(o_orderdate, '%Y_%m_%d') as band from orders),
d as (select band, try_strptime(nullif(regexp_extract(band, '^ndvi_(\d{4}_\d{2}_\d{2})$', 1), ''), '%Y_%m_%d')::date band_date from b)
select band, band_date, case when band_date is not null then row_number() over (partition by band_date is null order by band_date) end::int place from d""")
def band_name_parse(spark, sf_dir):
    from pyspark.sql import Window

    prefix = F.when(F.col("o_orderkey") % 7 == 0, "scl_").otherwise("ndvi_")
    bands = read(spark, sf_dir, "orders").select(F.concat(prefix, F.date_format("o_orderdate", "yyyy_MM_dd")).alias("band")).distinct()
    df = bands.withColumn("band_date", c.band_date(F.col("band")))
    # One row a band: ordering them in one task is cheap.
    order = Window.partitionBy(F.col("band_date").isNull()).orderBy("band_date")
    return df.withColumn("place", F.when(F.col("band_date").isNotNull(), F.row_number().over(order)))


@query(f"with {TS_SQL} select entity, k, end_date, round(nd, 6) nd, case when nd is null then 'missing' when nd < 0 then 'low' when nd < 0.5::double then 'mid' else 'high' end grade from nd")
def normalized_difference(spark, sf_dir):
    nd = F.col("nd")
    grade = F.when(nd.isNull(), "missing").when(nd < 0, "low").when(nd < 0.5, "mid").otherwise("high")
    return ts_curves(spark, sf_dir).select("entity", "k", "end_date", _R6(nd, "nd"), grade.alias("grade"))


@query(f"with {TS_SQL} select entity, count(distinct end_date) n_dates, 35 - count(distinct end_date) n_absent, min(end_date) first_date, max(end_date) last_date from nd group by entity having count(distinct end_date) >= 20")
def composite_completeness(spark, sf_dir):
    n = F.count_distinct("end_date")
    by = ts_curves(spark, sf_dir).groupBy("entity").agg(n.alias("n_dates"), F.min("end_date").alias("first_date"), F.max("end_date").alias("last_date"))
    return by.where("n_dates >= 20").select("entity", "n_dates", (N_DATES - F.col("n_dates")).alias("n_absent"), "first_date", "last_date")


_SMOOTH_SQL = "h as (select (unnest(range({n})))::int o, unnest({m}) r), hh as (select o, unnest(range({n}))::int i, unnest(r) w from h)"


@query(f"with {VEC_SQL}, {_SMOOTH_SQL.format(n=64, m=_rows_sql(c.hat_matrix(64)))} select vec_id, o pos, round(sum(w * x), 6) value from e join hh on pos = i group by vec_id, o")
def whittaker_complete(spark, sf_dir):
    df = vec_curves(spark, sf_dir).select("vec_id", c.smooth_complete(F.col("curve"), 64).alias("s"))
    return p.long_curves(df, "vec_id", curve="s").select("vec_id", "pos", _R6(F.col("x"), "value"))


@query()
def whittaker_gappy(spark, sf_dir):
    """Curves with gaps are solved in Arrow batches, once for each pattern of gaps in a batch."""
    df = ts_arrays(spark, sf_dir).where(c.has_value(F.col("curve"))).select("entity", c.smooth("curve").alias("s"))
    return p.long_curves(df, "entity", curve="s").select("entity", (F.col("pos") + 1).alias("k"), _R6(F.col("x"), "value"))


@query(f"""with {VEC_SQL}, {_SMOOTH_SQL.format(n=64, m=_rows_sql(c.hat_matrix(64)))}, g as (select (unnest(range(35)))::int o, unnest({_rows_sql(c.hat_matrix(35))}) r), gg as (select o, unnest(range(35))::int i, unnest(r) w from g),
a as (select vec_id, o - 16 pos, sum(w * x) y from e join hh on pos = i where o between 16 and 50 group by vec_id, o),
b as (select vec_id, o pos, sum(w * x) y from e join gg on pos - 16 = i group by vec_id, o)
select vec_id, round(max(abs(a.y - b.y)), 6) gap from a join b using (vec_id, pos) group by vec_id""")
def smooth_then_cut_vs_cut_then_smooth(spark, sf_dir):
    a = c.cut(c.smooth_complete(F.col("curve"), 64), 16, 35)
    b = c.smooth_complete(c.cut(F.col("curve"), 16, 35), 35)
    df = vec_curves(spark, sf_dir).select("vec_id", a.alias("a"), b.alias("b"))
    return df.select("vec_id", _R6(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))), "gap"))


@query(f"""with {TS_SQL}, ok as (select distinct entity from nd where nd is not null), ks as (select unnest(range(1, 36))::int k)
select ok.entity, ks.k, round(coalesce(nd.nd, 0), 6) value from ok cross join ks left join nd on nd.entity = ok.entity and nd.k = ks.k""")
def fill_and_reject_missing(spark, sf_dir):
    df = ts_arrays(spark, sf_dir).where(c.has_value(F.col("curve"))).select("entity", c.filled(F.col("curve")).alias("s"))
    return p.long_curves(df, "entity", curve="s").select("entity", (F.col("pos") + 1).alias("k"), _R6(F.col("x"), "value"))


@query(f"with {VEC_SQL} select label, pos, round(avg(x), 6) mean, round(quantile_cont(x, 0.25), 6) q25, round(quantile_cont(x, 0.75), 6) q75 from e group by label, pos")
def mean_iqr_curve(spark, sf_dir):
    each = p.long_curves(vec_curves(spark, sf_dir), "label")
    by = each.groupBy("label", "pos").agg(F.avg("x").alias("m")).join(quantiles(each, ["label", "pos"], [0.25, 0.75]), ["label", "pos"], "left")
    return by.select("label", "pos", _R6(F.col("m"), "mean"), _R6(F.col("q0"), "q25"), _R6(F.col("q1"), "q75"))


def _peaks(spark, sf_dir):
    """entity, peak_k (the first greatest value), peak_date, peak, trough, swing."""
    df = ts_curves(spark, sf_dir).where("nd is not null")
    top = F.min(F.struct((-F.col("nd")).alias("q"), "k", "end_date"))
    by = df.groupBy("entity").agg(top.alias("t"), F.max("nd").alias("peak"), F.min("nd").alias("trough"))
    return by.select("entity", F.col("t.k").alias("peak_k"), F.col("t.end_date").alias("peak_date"), "peak", "trough", (F.col("peak") - F.col("trough")).alias("swing"))


_PEAK_SQL = TS_SQL + """, pk as (select entity, k peak_k, end_date peak_date from (select *, row_number() over (partition by entity order by nd desc, k) r from nd where nd is not null) where r = 1),
sw as (select entity, max(nd) peak, min(nd) trough, max(nd) - min(nd) swing from nd where nd is not null group by entity)"""


@query(f"with {_PEAK_SQL} select entity, peak_k, peak_date, round(peak, 6) peak, round(trough, 6) trough, round(swing, 6) swing, peak_date between date '1997-07-01' and date '1997-10-15' in_season from pk join sw using (entity)")
def phenology_peak(spark, sf_dir):
    season = F.col("peak_date").between(F.lit("1997-07-01").cast("date"), F.lit("1997-10-15").cast("date"))
    return _peaks(spark, sf_dir).select("entity", "peak_k", "peak_date", _R6(F.col("peak"), "peak"), _R6(F.col("trough"), "trough"), _R6(F.col("swing"), "swing"), season.alias("in_season"))


@query(f"with {_PEAK_SQL}, g as (select entity % 5 grp, lower(strftime(peak_date, '%b')) m from pk) select grp, " + ", ".join(f"round(100.0::double * count(*) filter (m = '{m}') / count(*), 6) {m}_pct" for m in _MONTHS) + " from g group by grp")
def peak_month_crosstab(spark, sf_dir):
    df = _peaks(spark, sf_dir).select((F.col("entity") % 5).alias("grp"), F.lower(F.date_format("peak_date", "MMM")).alias("m"))
    return p.shares(df, "grp", "m", _MONTHS, _MONTHS).select("grp", *(_R6(F.col(m), f"{m}_pct") for m in _MONTHS))


@query(f"with {_PEAK_SQL} select entity, round(swing, 6) swing from sw where swing < 1.95::double order by sw.swing, entity limit 20")
def low_swing_entities(spark, sf_dir):
    df = _peaks(spark, sf_dir).where("swing < 1.95").orderBy("swing", "entity").limit(20)
    return df.select("entity", _R6(F.col("swing"), "swing"))


def _nearest(spark, sf_dir):
    df = vec_curves(spark, sf_dir)
    return p.nearest(p.profile_distances(df, p.median_profiles(df)))


_NEAR_SQL = PROFILE_SQL + """, rk as (select *, row_number() over (partition by vec_id order by d, cls) r, lead(d) over (partition by vec_id order by d, cls) - d margin from dist),
near as (select vec_id, label, tile, aoi, cls nearest, d distance, margin from rk where r = 1)"""


@query(f"with {_NEAR_SQL} select vec_id, label, nearest, round(distance, 6) distance, round(margin, 6) margin from near")
def nearest_profile(spark, sf_dir):
    return _nearest(spark, sf_dir).select("vec_id", "label", "nearest", _R6(F.col("distance"), "distance"), _R6(F.col("margin"), "margin"))


@query(f"with {_NEAR_SQL} select label, " + ", ".join(f"count(*) filter (nearest = {i}) as_{i}" for i in range(10)) + " from near group by label")
def nearest_profile_crosstab(spark, sf_dir):
    counts = _nearest(spark, sf_dir).groupBy("label").pivot("nearest", list(range(10))).agg(F.count(F.lit(1)))
    return counts.select("label", *(F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(f"as_{i}") for i in range(10)))


@query(f"""with {VEC_SQL}, pr as (select a.vec_id a, a.label label_a, b.vec_id b, b.label label_b, avg(abs(a.x - b.x)) gap from e a join e b using (pos) where (a.label = 1) <> (b.label = 1) group by all having avg(abs(a.x - b.x)) < 0.102::double)
select a, label_a, b, label_b, round(gap, 4) gap from (select *, row_number() over (partition by a order by gap, b) r from pr) where r = 1""")
def contradictory_pairs(spark, sf_dir):
    found = p.contradictions(vec_curves(spark, sf_dir), F.col("label") == 1, 0.102)
    return found.select("a", "label_a", "b", "label_b", F.round("gap", 4).alias("gap"))


@query(f"with {_NEAR_SQL} select vec_id, label from near where nearest <> 1")
def drop_near_positive(spark, sf_dir):
    df = vec_curves(spark, sf_dir)
    return p.drop_near(df, p.median_profiles(df), 1).select("vec_id", "label")


@query(f"""with {VEC_SQL}, v as (select distinct vec_id, label, tile from e), h as (select distinct tile held from v),
m as (select h.held, e.label cls, e.pos, median(e.x) m from e join h on e.tile <> h.held group by all),
n as (select held from m group by held having count(distinct cls) > 1),
d as (select e.vec_id, e.label, e.tile, m.cls, avg(abs(e.x - m.m)) d from e join m on m.held = e.tile and m.pos = e.pos where e.tile in (select held from n) group by all),
k as (select *, row_number() over (partition by vec_id order by d, cls) r from d)
select tile, count(*) "rows", round(100 * avg((cls = label)::int::double), 6) agreement_pct, count(*) filter (label = 1 and cls <> 1) positive_missed, count(*) filter (label <> 1 and cls = 1) negative_taken from k where r = 1 group by tile""")
def leave_one_group_out_profile(spark, sf_dir):
    got = p.leave_one_out(vec_curves(spark, sf_dir), "tile", 1)
    return got.select("tile", "rows", _R6(F.col("agreement_pct"), "agreement_pct"), "positive_missed", "negative_taken")
