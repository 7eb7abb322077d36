"""Queries on scores, reports and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curve as c
from ..operators import evaluate as e
from ..operators import profiles as p
from ..sources.adapters import VEC_SQL, vec_curves
from .registry import query
from .sampling import SCORE_SQL, V1, V2, scored

_R6 = lambda name: F.round(name, 6).alias(name)
_SC = SCORE_SQL.format(t=V2)
_MATRIX_SQL = _SC + """, cn as (select label truth, pred, count(*) n from sc group by all), ls as (select distinct x from (select truth x from cn union all select pred from cn)),
mx as (select a.x truth, b.x pred, coalesce(n, 0) n from ls a cross join ls b left join cn on cn.truth = a.x and cn.pred = b.x)"""
_REPORT_SQL = _MATRIX_SQL + """, tt as (select truth cls, sum(n) filter (truth = pred) tp, sum(n) support from mx group by truth), tk as (select pred cls, sum(n) taken from mx group by pred),
pr as (select cls, tp, support, case when taken > 0 then tp::double / taken else 0 end prec, case when support > 0 then tp::double / support else 0 end rec from tt join tk using (cls)),
rp as (select *, case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0 end f1 from pr)"""


def _matrix(spark, sf_dir):
    return e.confusion(scored(spark, sf_dir))


@query(f"with {_MATRIX_SQL} select truth, pred, n::bigint n from mx")
def confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(f"""with {_REPORT_SQL} select cls::varchar cls, round(prec, 6) "precision", round(rec, 6) recall, round(f1, 6) f1, support::bigint support from rp
union all select 'macro', null, round(avg(rec) filter (support > 0), 6), round(avg(f1) filter (support > 0), 6), sum(support)::bigint from rp
union all select 'accuracy', null, round(sum(tp)::double / sum(support), 6), null, sum(support)::bigint from rp""")
def classification_report(spark, sf_dir):
    rep = e.report(_matrix(spark, sf_dir))
    each = rep.select(F.col("cls").cast("string").alias("cls"), _R6("precision"), _R6("recall"), _R6("f1"), "support")
    null = F.lit(None).cast("double")
    n = rep.agg(F.sum("support").alias("support"))
    one = e.summary(rep).join(n, F.lit(True))
    macro = one.select(F.lit("macro").alias("cls"), null.alias("precision"), F.round("balanced_accuracy", 6).alias("recall"), F.round("macro_f1", 6).alias("f1"), "support")
    acc = one.select(F.lit("accuracy").alias("cls"), null.alias("precision"), F.round("accuracy", 6).alias("recall"), null.alias("f1"), "support")
    return each.unionByName(macro).unionByName(acc)


_SWEEP = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query(f"with {_SC}, ct as (select unnest({_SWEEP}::double[]) cut) select aoi, cut, " + ", ".join(f"round(100 * avg((p >= cut)::int::double) filter (label = {i}), 6) c{i}" for i in range(10)) + " from p1, ct group by aoi, cut")
def threshold_sweep(spark, sf_dir):
    df = scored(spark, sf_dir).select("aoi", "label", p.prob_of(1).alias("p"))
    by = e.rates(df, "p", _SWEEP, "aoi", "label").groupBy("aoi", "cut").pivot("label", list(range(10))).agg(F.first("pct"))
    return by.select("aoi", "cut", *(F.round(F.col(f"`{i}`"), 6).alias(f"c{i}") for i in range(10)))


def _both(spark, sf_dir):
    """Curves with both models' probabilities, pa and pb, against the same profiles."""
    df = vec_curves(spark, sf_dir)
    dists = p.profile_distances(df, p.median_profiles(df))
    a = p.softmax(dists, float(V1)).withColumn("pa", p.prob_of(1)).drop("best", "sharpness", "pred", "conf")
    return p.softmax(a, float(V2)).withColumn("pb", p.prob_of(1))


_TARGETS = [75.0, 78.0, 80.0, 83.0, 85.0]
_BOTH_SQL = SCORE_SQL.format(t=V1) + ", " + SCORE_SQL.format(t=V2).split("dist as (")[1].split(",\n", 1)[1].replace("mn as", "mn2 as").replace("join mn using", "join mn2 using").replace("ex as", "ex2 as").replace("from ex)", "from ex2)").replace("pb as", "pb2 as").replace("from pb)", "from pb2)").replace("sc as", "sc2 as").replace("p1 as", "p2 as").replace("from pb where", "from pb2 where")


@query(f"""with {_BOTH_SQL}, al as (select 'v1' model, label, p from p1 union all select 'v2', label, p from p2), ct as (select unnest({e.CUTS}::double[]) cut),
rt as (select model, cut, label, 100 * avg((p >= cut)::int::double) pct from al, ct group by all), wd as (select model, cut, max(pct) filter (label = 1) recall, avg(pct) filter (label <> 1) mc from rt group by all),
rk as (select *, row_number() over (partition by model, target order by abs(recall - target), cut) r from wd, (select unnest({_TARGETS}::double[]) target) t)
select model, target, cut, round(recall, 6) recall, round(mc, 6) mean_commission from rk where r = 1""")
def matched_recall(spark, sf_dir):
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in (("v1", "pa"), ("v2", "pb"))))).alias("m")
    got = e.matched_recall(_both(spark, sf_dir).select("label", each).select("label", "m.*"), "p", _TARGETS, 1)
    return got.select("model", "target", "cut", _R6("recall"), _R6("mean_commission"))


@query(f"""with {_BOTH_SQL}, j as (select a.vec_id, a.aoi, a.label, a.p >= 0.3::double x, b.p >= 0.3::double y from p1 a join p2 b using (vec_id))
select coalesce(aoi::varchar, 'POOLED') aoi, label, count(*) pixels, case when label = 1 then 'recall' else 'commission' end meaning, round(100 * avg(x::int::double), 6) a_pct, round(100 * avg(y::int::double), 6) b_pct, round(100 * avg(y::int::double) - 100 * avg(x::int::double), 6) delta
from j group by grouping sets ((aoi, label), (label))""")
def model_comparison_pooled(spark, sf_dir):
    """Both models' probabilities come from one pass over the distances."""
    got = e.compared(_both(spark, sf_dir), F.col("pa") >= 0.3, F.col("pb") >= 0.3, 1)
    return got.select("aoi", "label", "pixels", "meaning", *map(_R6, ("a_pct", "b_pct", "delta")))


@query(f"with {_SC} select vec_id, sc.label, pred looks_like, round(conf, 6) confidence, round(p, 6) p_positive from sc join p1 using (vec_id) where pred <> sc.label and conf >= 0.6::double")
def second_opinion_disagreement(spark, sf_dir):
    df = scored(spark, sf_dir).where((F.col("pred") != F.col("label")) & (F.col("conf") >= 0.6))
    return df.select("vec_id", "label", F.col("pred").alias("looks_like"), F.round("conf", 6).alias("confidence"), F.round(p.prob_of(1), 6).alias("p_positive"))


@query(f"""with {_SC} select vec_id, case when label = 4 and conf >= 0.7::double then pred else label end label, label = 4 and conf >= 0.7::double and pred <> 4 moved,
case (case when label = 4 and conf >= 0.7::double then pred else label end) when 1 then 'cotton' when 2 then 'rice' when 3 then 'sugarcane' when 4 then 'other' when 5 then 'fall_maize' when 6 then 'orchard' end crop from sc""")
def confidence_relabel(spark, sf_dir):
    from ..schema import NAMES

    sure = (F.col("label") == 4) & (F.col("conf") >= 0.7)
    names = F.create_map(*(x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))))
    df = scored(spark, sf_dir).select("vec_id", F.when(sure, F.col("pred")).otherwise(F.col("label")).alias("label"), (sure & (F.col("pred") != 4)).alias("moved"))
    return df.withColumn("crop", F.try_element_at(names, F.col("label")))


@query(f"""with {VEC_SQL}, med as (select label cls, pos, median(x) m from e where pos < 35 group by all),
a as (select vec_id, label, cls, avg(abs(x - m)) d from e join med using (pos) group by all), b as (select vec_id, label, cls, avg(abs(x - m)) d from e join med on e.pos - 1 = med.pos group by all),
na as (select vec_id, label, cls from (select *, row_number() over (partition by vec_id order by d, cls) r from a) where r = 1), nb as (select vec_id, cls from (select *, row_number() over (partition by vec_id order by d, cls) r from b) where r = 1)
select label, count(*) n, count(*) filter (na.cls <> nb.cls) moved, round(100 * avg((na.cls = 1)::int::double), 6) aligned_pct, round(100 * avg((nb.cls = 1)::int::double), 6) shifted_pct from na join nb using (vec_id) group by label""")
def window_shift_ab(spark, sf_dir):
    """The same curves read through windows one step apart, against profiles of the first."""
    df = vec_curves(spark, sf_dir)
    keep = ["vec_id", "label"]
    a = df.select(*keep, "curve", c.cut(F.col("curve"), 0, 35).alias("w0"), c.cut(F.col("curve"), 1, 35).alias("w1"))
    prof = p.median_profiles(a.select("label", F.col("w0").alias("curve")))
    one = p.nearest(p.profile_distances(a.select(*keep, "w1", F.col("w0").alias("curve")), prof)).select(*keep, "w1", F.col("nearest").alias("n0"))
    two = p.nearest(p.profile_distances(one.withColumnRenamed("w1", "curve"), prof))
    pct = lambda x: F.round(100 * F.avg((x == 1).cast("double")), 6)
    return two.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n0") != F.col("nearest")).alias("moved"), pct(F.col("n0")).alias("aligned_pct"), pct(F.col("nearest")).alias("shifted_pct"))


@query(f"with {_SC}, h as (select label = 1 positive, least(floor(p * 25), 24)::bigint bin, count(*) n from p1 group by all) select positive, bin, n, round(n * 25.0::double / sum(n) over (partition by positive), 6) density from h")
def histogram_density(spark, sf_dir):
    df = scored(spark, sf_dir).select((F.col("label") == 1).alias("positive"), p.prob_of(1).alias("p"))
    return e.histogram(df, "p", 25, "positive").select("positive", "bin", "n", _R6("density"))


@query("select label, count(*) n_rows, count(distinct vec_id % 12) n_tiles, array_to_string(list_sort(list(distinct vec_id % 12)), ',') tiles, max(len(embedding))::int n_features from embeddings group by label")
def model_card_rows(spark, sf_dir):
    df = vec_curves(spark, sf_dir)
    tiles = F.array_sort(F.collect_set("tile"))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("tile").alias("n_tiles"), F.array_join(F.transform(tiles, lambda t: t.cast("string")), ",").alias("tiles"), F.max(F.size("curve")).alias("n_features"))
