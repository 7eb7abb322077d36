"""Queries on sampling and sets of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as p
from ..operators import sampling as s
from ..sources.adapters import PROFILE_SQL, read, vec_curves
from .registry import query

SEED = 42
SCORE_SQL = PROFILE_SQL + """,
mn as (select vec_id, min(d) dm from dist group by vec_id),
ex as (select dist.*, exp(-{t}::double * (d - dm)) w from dist join mn using (vec_id)),
pb as (select vec_id, label, tile, aoi, cls, w / sum(w) over (partition by vec_id) p from ex),
sc as (select vec_id, label, tile, aoi, cls pred, p conf from (select *, row_number() over (partition by vec_id order by p desc, cls) r from pb) where r = 1),
p1 as (select vec_id, label, tile, aoi, p from pb where cls = 1)"""
V1, V2 = 400, 1000


def scored(spark, sf_dir, sharpness=V2):
    return p.scores(vec_curves(spark, sf_dir), float(sharpness))


@query("""select 'embeddings' source, label::varchar value, count(*) n from embeddings group by label
union all select 'lineitem', l_returnflag, count(*) from lineitem group by l_returnflag
union all select 'lineitem_status', l_linestatus, count(*) from lineitem group by l_linestatus""")
def class_counts(spark, sf_dir):
    e, li = read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "lineitem")
    count = lambda df, name, c: df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "value", "n")
    return count(e, "embeddings", "label").unionByName(count(li, "lineitem", "l_returnflag")).unionByName(count(li, "lineitem_status", "l_linestatus"))


_LINE = "l_orderkey::varchar || '-' || l_linenumber::varchar"


@query(f"select l_returnflag, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_returnflag order by md5(({_LINE}) || ':{SEED}'), {_LINE}) r from lineitem) where r <= 100")
def cap_per_class(spark, sf_dir):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return s.cap(df, 100, key, SEED, "l_returnflag")


@query(f"select vec_id, label, vec_id % 12 tile from (select *, row_number() over (partition by vec_id % 12, label order by md5(vec_id::varchar || ':{SEED}'), vec_id::varchar) r from embeddings) where r <= 3")
def cap_per_tile_class(spark, sf_dir):
    df = vec_curves(spark, sf_dir).select("vec_id", "label", "tile")
    return s.cap(df, 3, F.col("vec_id").cast("string"), SEED, "tile", "label")


@query(f"select o_orderkey, o_totalprice from orders order by md5(o_orderkey::varchar || ':{SEED}'), o_orderkey limit 250")
def cap_global(spark, sf_dir):
    return s.cap_all(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 250, F.col("o_orderkey"), SEED)


@query(f"""with {SCORE_SQL.format(t=V2)}, w as (select vec_id, label, pred <> label wrong from sc),
r as (select *, row_number() over (partition by label, wrong order by md5(vec_id::varchar || ':{SEED}'), vec_id::varchar) r from w),
h as (select label, least(count(*), 10) h from w where wrong group by label)
select vec_id, r.label, wrong is_hard from r left join h using (label) where r <= case when wrong then 10 else 20 - coalesce(h, 0) end""")
def hard_easy_quota(spark, sf_dir):
    df = scored(spark, sf_dir).select("vec_id", "label", "pred")
    return s.hard_easy(df, 20, 0.5, F.col("pred") != F.col("label"), F.col("vec_id").cast("string"), SEED, "label").select("vec_id", "label", "is_hard")


@query("""select vec_id id, label code, (vec_id % 12)::varchar tile, null::double lon, null::double lat from embeddings
union all by name select p_partkey id, 4 code, 'old_' || p_brand tile, null::double lon, null::double lat from part where p_size <= 5""")
def union_by_name_generic(spark, sf_dir):
    new = vec_curves(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("code"), F.col("tile").cast("string").alias("tile"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))
    old = read(spark, sf_dir, "part").where("p_size <= 5").select(F.concat(F.lit("old_"), "p_brand").alias("tile"), F.col("p_partkey").alias("id"), F.lit(4).alias("code"))
    return new.unionByName(old, allowMissingColumns=True)


@query("""with a as (select distinct label from embeddings where vec_id % 12 < 3), b as (select distinct label from embeddings where vec_id % 12 >= 6), k as (select unnest([1, 2, 3, 4, 5, 6])::int label)
select 'unknown' kind, label from (select label from a except select label from k)
union all select 'absent', label from (select label from k except select label from a)
union all select 'shared', label from (select label from a intersect select label from b)
union all select 'covered', label from (select label from a union select label from b)""")
def set_difference_codes(spark, sf_dir):
    df = vec_curves(spark, sf_dir).select("label", "tile")
    a, b = df.where("tile < 3").select("label").distinct(), df.where("tile >= 6").select("label").distinct()
    known = spark.createDataFrame([(i,) for i in range(1, 7)], "label int")
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "label")
    return kind(a.subtract(known), "unknown").union(kind(known.subtract(a), "absent")).union(kind(a.intersect(b), "shared")).union(kind(a.union(b).distinct(), "covered"))
