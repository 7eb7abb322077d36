"""URL filter: allow and block rules, and the reputation of hosts for the rest.

Pages that a rule fits are labelled outcomes: allowed ones good, blocked ones
bad. Outcomes are counted for each name, registered domain and public suffix, and
shrunk from the top down: all pages, suffix, domain, name. At each level a beta
prior has the posterior mean of the level above, and the strength that the method
of moments finds in the spread of that level's units. A page without a rule is
blocked if the upper posterior bound of its name's share of good outcomes lies
below a threshold.

The name is the host without user, port and final dot. Its suffix is the last
label, or the last two where ``SUFFIXES`` lists them, and its domain has one label
more. Addresses in digits or brackets are domains of their own, under the suffix
``ip``. The host that comes back is the one of the contract, with all that.

A name without outcomes takes the posterior of its domain, then of its suffix,
then of all pages. Null urls and urls without ``://`` have an empty host and
path, and are judged like any other host. Without any outcome nothing is
blocked. Repeated pages count as often as they occur. Of rules that fit, the
longest wins; two of one length never both fit. Very long urls are read whole. Only
page_id and url are read, so other columns may have any names. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: verdict, host, path
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Public suffixes of two labels (fixed values; common ones, as of 2025). Others are taken as one label.
SUFFIXES = [
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.bd", "com.br", "com.cn",
    "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au",
    "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "sch.uk",
]
#: Standard deviations of the posterior bound, and the share of good outcomes it must reach.
BOUND, LEAST_GOOD = 2.0, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and ruled (the longest fitting rule and its verdict, else null)."""
    host, path = split_url(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones override
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("ruled", verdict)


def name_of(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.?(:[0-9]*)?$", "")


def units_of(name: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix."""
    address = name.rlike(r"^([0-9.]+|\[.*)$")
    two = F.substring_index(name, ".", -2)
    listed = two.isin(SUFFIXES)
    domain = F.when(address, name).when(listed, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(address, "ip").when(listed, two).otherwise(F.substring_index(name, ".", -1))


def host_outcomes(pages: DataFrame) -> DataFrame:
    """name, domain, suffix, good, n: labelled outcomes of every name that has pages."""
    good, n = F.count_if(F.col("ruled") == "allow"), F.count("ruled")
    domain, suffix = units_of(F.col("name"))
    return pages.groupBy("name").agg(good.alias("good"), n.alias("n")).select("name", domain.alias("domain"), suffix.alias("suffix"), "good", "n")


def _strength(units: DataFrame) -> DataFrame:
    """One row: the strength of the beta prior over ``units`` (good, n), from
    their spread: sum n (p - mean)^2 = sum good^2 / n - (sum good)^2 / sum n."""
    n, good = F.col("n").cast("double"), F.col("good").cast("double")
    a = units.where("n > 0").agg(F.sum(good * good / n).alias("gg"), F.sum(good).alias("g"), F.sum(n).alias("m"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).alias("k"))
    mean = F.try_divide("g", "m")
    chi = F.try_divide(F.col("gg") - F.try_divide(F.col("g") * F.col("g"), F.col("m")), mean * (1 - mean))
    rho = F.try_divide(chi - (F.col("k") - 1), F.col("m") - F.try_divide("nn", "m") - (F.col("k") - 1))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(0.01)), F.lit(0.99))
    return a.select((1 / rho - 1).alias("strength"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """name, mean, upper: posterior mean and upper bound of each name's share of good outcomes.

    The tables have one row a name, domain or suffix; ``outcomes`` is read several times.
    """
    domains = outcomes.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    overall = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("above"))

    def shrunk(units: DataFrame, above: DataFrame, key: list[str], out: list[str]) -> DataFrame:
        df = units.join(F.broadcast(_strength(units)), F.lit(True), "left")  # one row
        df = df.join(above, key, "left") if key else df.join(F.broadcast(above), F.lit(True), "left")
        a = F.col("above") * F.col("strength") + F.col("good")
        b = (1 - F.col("above")) * F.col("strength") + F.col("n") - F.col("good")
        return df.select(*out, (a / (a + b)).alias("above"), (a + b).alias("weight"))

    by_suffix = shrunk(suffixes, overall, [], ["suffix"])
    by_domain = shrunk(domains, by_suffix.select("suffix", "above"), ["suffix"], ["domain"])
    by_name = shrunk(outcomes, by_domain.select("domain", "above"), ["domain"], ["name"])
    m, w = F.col("above"), F.col("weight")
    return by_name.select("name", m.alias("mean"), (m + BOUND * F.sqrt(m * (1 - m) / (w + 1))).alias("upper"))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    df = written(ruled(pages, rules).withColumn("name", name_of(F.col("host"))), "pages-ruled")
    bad = written(reputations(written(host_outcomes(df), "host-outcomes")).where(F.col("upper") < LEAST_GOOD).select("name", F.lit(True).alias("bad")), "names-bad")
    judged = df.join(bad, "name", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


_FITS = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_LEVEL = """{name}_s as (select 1 / least(greatest(coalesce((x - (k - 1)) / nullif(m - nn / nullif(m, 0) - (k - 1), 0), 0.5::double), 0.01::double), 0.99::double) - 1 s from
 (select (sum(g::double * g / n) - sum(g::double) * sum(g::double) / nullif(sum(n::double), 0)) / nullif(sum(g::double) / nullif(sum(n::double), 0) * (1 - sum(g::double) / nullif(sum(n::double), 0)), 0) x, sum(n::double) m, sum(n::double * n) nn, count(*) k from {name}_n where n > 0)),
{name}_p as (select u.{name}, (above * s + g) / (s + n) m, s + n w from {name}_n u join {up} cross join {name}_s)"""
SQL = r"""
with a as (select page_id, coalesce(url, '') url, strpos(coalesce(url, ''), '://') cut from pages),
b as (select page_id, case when cut > 0 then substr(url, cut + 3) else '' end rest from a),
c as (select page_id, regexp_extract(rest, '^[^?#]*', 0) hp from b),
d as (select page_id, translate(regexp_extract(hp, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, substr(hp, length(regexp_extract(hp, '^[^/]*', 0)) + 1) path from c),
r as (select *, case RULES end rule, case VERDICTS end ruled, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\.?(:[0-9]*)?$', '') "name" from d),
u as (select "name", count(*) filter (ruled = 'allow') g, count(ruled) n, regexp_matches("name", '^([0-9.]+|\[.*)$') address, regexp_extract("name", '([^.]*\.)?[^.]*$') two from r group by "name"),
name_n as (select "name", g, n, case when address then "name" when two in (SUFFIXES) then regexp_extract("name", '([^.]*\.){0,2}[^.]*$') else two end "domain",
 case when address then 'ip' when two in (SUFFIXES) then two else regexp_extract("name", '[^.]*$') end suffix from u),
domain_n as (select "domain", suffix, sum(g)::bigint g, sum(n)::bigint n from name_n group by all),
suffix_n as (select suffix, sum(g)::bigint g, sum(n)::bigint n from domain_n group by all),
top as (select (coalesce(sum(g), 0) + 1)::double / (coalesce(sum(n), 0) + 2) above from suffix_n),
LEVELS,
h as (select "name", m + 2 * sqrt(m * (1 - m) / (w + 1)) upper_bound from name_p)
select page_id, host, path, rule, coalesce(ruled, case when upper_bound < 0.5 then 'block' else 'allow' end) verdict from r join h using ("name")
""".replace("SUFFIXES", ", ".join(f"'{x}'" for x in SUFFIXES)).replace("RULES", " ".join(f"when {_FITS.format(h=h, p=p)} then '{h + p}'" for _, h, p in _BY_LENGTH)).replace(
    "VERDICTS", " ".join(f"when {_FITS.format(h=h, p=p)} then '{v}'" for v, h, p in _BY_LENGTH)
).replace("LEVELS", ",\n".join([
    _LEVEL.format(name="suffix", up="top on true"),
    _LEVEL.format(name="domain", up="(select suffix up, m above from suffix_p) on suffix = up").replace("u.domain", 'u."domain"'),
    _LEVEL.format(name="name", up="(select \"domain\" up, m above from domain_p) on \"domain\" = up").replace("u.name", 'u."name"'),
]))
