"""Quality rules with thresholds that adapt to language and source.

Each text gives a few counts. Their ratios go into histograms of bounded
relative error (64 bins for each power of two), one for each language, source
and ratio, over the texts that pass the base rules. Such histograms merge by
adding counts, in any order and with the same result, so those of a language
and of all texts come from the same table.

A ratio's fences are its quartiles widened by the distances between them:
``q75 + REACH * (q75 - q50)`` above and ``q25 - REACH * (q50 - q25)`` below. No
value is fixed. Where the quartiles coincide (most texts have no symbol at all)
the fence is the quartile itself. A group's fence is shrunk to its language's, and
that to the one of all texts, with the weight of ``SHRINK`` texts. A group whose
median lies within its parent's fence and whose upper quartile lies beyond it is
a mixture with bad texts, and takes its parent's upper fence.

A text fails if its count is beyond the fence by more than ``SIGMAS`` standard
deviations of a count of its size (the variance of a Poisson count, times the
number of units that one event adds), so short texts and lone events don't fail.

Null or empty texts have no words, so they fail the base rules. Null languages
and sources form groups of their own. Repeated rows count as often as they
occur, and equal texts of a group get one verdict. Very long texts are measured
whole, in one row of memory. Columns of the documents may have any names: they
travel in a struct. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, boxed, table, words, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: name, numerator and denominator as SQL, units that one event adds. Ratios are in thousandths. A repeated window adds two windows of words.
RATIOS = [
    ("symbols", "n_symbols", "n_words", 1),
    ("dup_lines", "n_dup_lines", "n_lines", 1),
    ("repeats", "n_repeat_words", "n_words", 2 * WINDOW),
    ("word_len", "word_chars", "n_words", 1),
]
REACH, SHRINK, SIGMAS = 6, 50, 3


def _shifted(h: str, by: int) -> Column:
    """Hash of each element of ``h`` with the one ``by`` places on, as far as there is one."""
    n = F.size(h)
    return F.when(n > by, F.zip_with(F.slice(h, F.lit(1), F.greatest(n - by, F.lit(0))), F.slice(h, F.lit(by + 1), F.greatest(n - by, F.lit(0))), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with word_chars, n_words, n_lines, n_symbols, n_dup_lines, n_repeat_words (all long).

    Column names that begin with ``_q`` are used in between.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("_qt"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_qt", text).withColumn("_qw", words(F.col("_qt"))).withColumn("_ql", lines)
    df = df.withColumns({
        "_q1": F.transform("_qw", lambda w: F.xxhash64(w)),
        "n_words": F.size("_qw").cast("long"),
        "word_chars": F.length(F.translate("_qt", " \t\n\x0b\f\r", "")).cast("long"),
        "n_lines": F.size("_ql").cast("long"),
        "n_symbols": (F.length("_qt") - F.length(F.translate("_qt", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_ql") - F.size(F.array_distinct("_ql"))).cast("long"),
    }).drop("_qw", "_ql", "_qt")
    df = df.withColumn("_q2", _shifted("_q1", 1)).withColumn("_q4", _shifted("_q2", 2)).withColumn("_q8", _shifted("_q4", 4)).drop("_q1", "_q2", "_q4")
    # Only texts with a window found twice are sorted.
    df = df.withColumn("_qs", F.when(F.size(F.array_distinct("_q8")) < F.size("_q8"), F.sort_array(F.transform("_q8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        F.transform("_qs", lambda e, i: F.when((F.try_element_at("_qs", F.when(i > 0, i))["h"] == e["h"]) | (F.try_element_at("_qs", i + 2)["h"] == e["h"]), e["i"])),
        lambda i: i.isNotNull(),
    )
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(F.sort_array("_qp"), start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")), lambda a: a["n"])
    df = df.withColumn("_qp", F.when(F.col("_qs").isNotNull(), twice))
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_q8", "_qs", "_qp")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ratio(top: str, bottom: str) -> Column:
    return F.expr(f"1000 * {top} div greatest({bottom}, 1)")


def _bin(v: Column) -> Column:
    """The value with all but its first seven binary digits set to zero."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(counts: DataFrame) -> DataFrame:
    """The mergeable histograms: lang, source, ratio, bin, n, over the texts that pass the base rules."""
    each = F.array(*(F.struct(F.lit(name).alias("ratio"), _bin(_ratio(a, b)).alias("bin")) for name, a, b, _ in RATIOS))
    return counts.where(~base_failed()).select("lang", "source", F.explode(each).alias("_e")).groupBy("lang", "source", F.col("_e.ratio").alias("ratio"), F.col("_e.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _quantile(q: int) -> Column:
    """Of the sorted (bin, n) pairs ``_b`` with total ``_n``: the first bin at which q hundredths of the rows are reached."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("v"))
    return F.aggregate("_b", start, lambda a, e: F.struct((a["n"] + e["n"]).alias("n"), F.coalesce(a["v"], F.when(100 * (a["n"] + e["n"]) >= q * F.col("_n"), e["bin"])).alias("v")), lambda a: a["v"])


def fences(sketch: DataFrame, reach: int = REACH, shrink: int = SHRINK) -> DataFrame:
    """_fl, _fs (language, source), and ``_fences``: for each ratio the upper and the lower fence."""

    def of(*keys: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
        got = merged.groupBy(*keys, "ratio").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("_b"), F.sum("n").alias("_n"))
        got = got.select(*keys, "ratio", F.col("_n").alias("n"), *(_quantile(q).alias(f"q{q}") for q in (25, 50, 75)))
        return got.withColumn("up", F.expr(f"q75 + {reach} * (q75 - q50)")).withColumn("low", F.expr(f"greatest(q25 - {reach} * (q50 - q25), 0L)"))

    def shrunk(units: DataFrame, above: DataFrame, on) -> DataFrame:
        """``units`` joined to the fences ``a_up`` and ``a_low`` of the level above."""
        mixed = F.expr("case when q50 <= a_up and q75 > a_up then a_up else up end")
        df = units.join(above, on).withColumn("up", mixed)
        return df.withColumns({c: F.expr(f"(n * {c} + {shrink} * a_{c}) div (n + {shrink})") for c in ("up", "low")})

    named = lambda df, ratio, *more: df.select(*more, F.col("ratio").alias(ratio), F.col("up").alias("a_up"), F.col("low").alias("a_low"))
    langs = shrunk(of("lang"), named(of(), "_ar"), F.col("ratio") == F.col("_ar"))
    langs = named(langs, "_lr", F.col("lang").alias("_ll"))
    own = shrunk(of("lang", "source"), langs, (F.col("ratio") == F.col("_lr")) & F.col("lang").eqNullSafe(F.col("_ll")))
    each = F.collect_list(F.struct("ratio", F.struct("up", "low")))
    return own.groupBy(F.col("lang").alias("_fl"), F.col("source").alias("_fs")).agg(F.map_from_entries(each).alias("_fences"))


def judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """``counts`` with base_failed, kept and beyond (the ratios beyond a fence, of texts that pass the base rules)."""
    df = beside(counts, limits, F.col("lang").eqNullSafe(F.col("_fl")) & F.col("source").eqNullSafe(F.col("_fs")))
    df = df.withColumn("base_failed", base_failed())
    names = []
    for name, top, bottom, units in RATIOS:
        up, low = (F.col("_fences")[name][c] * F.col(bottom) for c in ("up", "low"))
        gap = F.greatest(1000 * F.col(top) - up, low - 1000 * F.col(top)).cast("double")
        names.append(F.when((gap > 0) & (gap * gap > 1e6 * SIGMAS**2 * units * F.col(top)), name))
    beyond = F.when(F.col("base_failed"), "").otherwise(F.concat_ws(",", *names))
    return df.withColumn("beyond", beyond).withColumn("kept", ~F.col("base_failed") & (F.col("beyond") == "")).drop("_fl", "_fs", "_fences")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and beyond of every document; the text is read once."""
    counts = written(measured(docs).select("doc_id", "lang", "source", "n_lines", *COUNTS), "quality-counts")
    return judged(counts, written(fences(sketches(counts)), "quality-fences")).select("doc_id", *COUNTS, "base_failed", "kept", "beyond")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass. Each text is measured once: the rows are written with their counts, and the verdict is joined to them."""
    rows = written(measured(boxed(docs, "text", "lang", "source")).drop("text"), "quality-rows")
    return judged(rows, written(fences(sketches(rows)), "quality-fences")).where("kept").select("_row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive d as (select doc_id, lang, source, coalesce(text, '') t from documents),
w as (select doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
c as (select doc_id, lang, source, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
 len(ls)::bigint n_lines, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
 (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, ws from w),
win as (select doc_id, i, array_to_string(ws[i:i+7], ' ') g from (select doc_id, ws, unnest(range(1, n_words - 6)) i from c where n_words >= 8)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) k from win) where k > 1),
cov as (select doc_id, count(distinct j)::bigint n from (select doc_id, unnest(range(i, i + 8)) j from rep) group by 1),
m as (select c.* exclude (ws), coalesce(cov.n, 0)::bigint n_repeat_words from c left join cov using (doc_id)),
j as (select m.*, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) base_failed from m),
r as (select doc_id, lang, source, unnest([{ratios}]) e from j where not base_failed),
v as (select doc_id, lang, source, e.ratio ratio, e.top top, e.bottom bottom, e.units units, (1000 * e.top) // greatest(e.bottom, 1) v, greatest(length(bin((1000 * e.top) // greatest(e.bottom, 1))) - 7, 0)::int s from r),
b as (select *, ((v >> s) << s)::bigint b from v),
qs as (select lang, source, ratio, grouping(lang) gl, grouping(source) gs, quantile_disc(b, 0.25) q25, quantile_disc(b, 0.5) q50, quantile_disc(b, 0.75) q75, count(*) n from b group by grouping sets ((lang, source, ratio), (lang, ratio), (ratio))),
f as (select *, q75 + {reach} * (q75 - q50) up, greatest(q25 - {reach} * (q50 - q25), 0) low from qs),
fa as (select ratio, up, low from f where gl = 1),
fl as (select f.lang, f.ratio, (n * (case when q50 <= fa.up and q75 > fa.up then fa.up else f.up end) + {shrink} * fa.up) // (n + {shrink}) up, (n * f.low + {shrink} * fa.low) // (n + {shrink}) low from f join fa using (ratio) where gl = 0 and gs = 1),
fs as (select f.lang, f.source, f.ratio, (n * (case when q50 <= fl.up and q75 > fl.up then fl.up else f.up end) + {shrink} * fl.up) // (n + {shrink}) up, (n * f.low + {shrink} * fl.low) // (n + {shrink}) low
 from f join fl on f.ratio = fl.ratio and f.lang is not distinct from fl.lang where gl = 0 and gs = 0),
t as (select b.doc_id, b.ratio, b.top, b.units, greatest(1000 * b.top - fs.up * b.bottom, fs.low * b.bottom - 1000 * b.top)::double gap from b join fs on b.ratio = fs.ratio and b.lang is not distinct from fs.lang and b.source is not distinct from fs.source),
bad as (select doc_id, string_agg(distinct ratio, ',' order by list_position([{names}], ratio)) beyond from t where gap > 0 and gap * gap > 1e6::double * {sigmas} * units * top::double group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and beyond is null kept, coalesce(beyond, '') beyond from j left join bad using (doc_id)
""".replace("with recursive", "with").replace("{reach}", str(REACH)).replace("{shrink}", str(SHRINK)).replace("{sigmas}", str(SIGMAS**2)).replace("{names}", ", ".join(f"'{n}'" for n, *_ in RATIOS)).replace(
    "{ratios}", ", ".join(f"{{'ratio': '{n}', 'top': {a}, 'bottom': {b}, 'units': {u}}}" for n, a, b, u in RATIOS))
