"""Queries on keys, listings and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..sources import io
from ..sources.adapters import read
from .registry import query
from .scoring import _REPORT_SQL, classification_report


@query(r"""with u as (select page_id, split_part(regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', ''), '/', -1) last, url from pages)
select page_id, lower(replace(regexp_extract(url, '://([^/?#]*)', 1), '-', '_')) slug, split_part(regexp_replace(last, '\.[^.]*$', ''), '__', 1) stem, starts_with(url, 'https') secure from u""")
def slug_and_stem_keys(spark, sf_dir):
    path = F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/+$", "")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    slug = F.lower(F.replace(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("-"), F.lit("_")))
    return read(spark, sf_dir, "pages").select("page_id", slug.alias("slug"), F.element_at(F.split(stem, "__"), 1).alias("stem"), F.startswith("url", F.lit("https")).alias("secure"))


@query("""with r as (select n_name slug, 'run_' || (2020 + r_regionkey + k) run, case when (n_nationkey + k) % 3 = 0 then n_name || '_sieved' end sieved, n_name || '_raw_' || k raw from nation join region on n_regionkey = r_regionkey, range(3) t(k)),
b as (select slug, max(run) run from r group by slug) select slug, run, coalesce(max(sieved), max(raw)) path from r join b using (slug, run) group by slug, run""")
def latest_run_fallback(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    runs = n.select(
        F.col("n_name").alias("slug"), F.concat(F.lit("run_"), (2020 + F.col("n_regionkey") + F.col("k")).cast("string")).alias("run"),
        F.when((F.col("n_nationkey") + F.col("k")) % 3 == 0, F.concat("n_name", F.lit("_sieved"))).alias("sieved"), F.concat("n_name", F.lit("_raw_"), F.col("k").cast("string")).alias("raw"),
    )
    return io.latest_runs(runs)


@query("""with r as (select 'blob_' || o_orderkey name, round(o_totalprice)::bigint size from orders), l as (select 'blob_' || o_orderkey name, (round(o_totalprice) + case when o_orderkey % 11 = 0 then 1 else 0 end)::bigint size from orders where o_orderkey % 3 <> 0)
select name, size from r where (name, size) not in (select name, size from l)""")
def listing_sync_antijoin(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("blob_"), F.col("o_orderkey").cast("string")).alias("name"), F.round("o_totalprice").cast("long").alias("size"))
    local = o.where("o_orderkey % 3 <> 0").withColumn("size", F.col("size") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0))
    return io.to_fetch(o.select("name", "size"), local)


@query("select s_suppkey, s_nationkey, s_acctbal from supplier order by s_nationkey, s_acctbal desc, s_suppkey limit 20")
def limited_sorted_items(spark, sf_dir):
    df = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return io.top(df, 20, F.col("s_nationkey"), F.col("s_acctbal").desc(), F.col("s_suppkey"))


@query(f'with {_REPORT_SQL} select cls::varchar cls, round(prec, 6) "precision", round(f1, 6) f1, support::bigint support from rp')
def json_metrics_roundtrip(spark, sf_dir):
    rep = classification_report(spark, sf_dir).where("cls not in ('macro', 'accuracy')")
    text = rep.select(F.to_json(F.struct("cls", F.struct("precision", "f1", "support").alias("m"))).alias("j"))
    back = text.select(F.from_json("j", "cls string, m struct<precision: double, f1: double, support: bigint>").alias("d"))
    return back.select("d.cls", "d.m.precision", "d.m.f1", "d.m.support")


@query()
def resumable_write(spark, sf_dir):
    """The second run adds only the items that the first lacked."""
    path = scratch(spark, "resumable")
    df = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    first = io.write_missing(spark, df.where("s_suppkey % 2 = 0"), path, "s_suppkey")
    second = io.write_missing(spark, df, path, "s_suppkey")
    third = io.write_missing(spark, df, path, "s_suppkey")
    return spark.createDataFrame([(1, first), (2, second), (3, third)], "run int, added long")
