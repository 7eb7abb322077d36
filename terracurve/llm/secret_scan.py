"""Secret scan over a ledger of blobs.

Every version of a text is a blob, named by its SHA-256. The ledger holds, for
each blob, the ``rule@version`` pairs it was scanned under, and the findings.
A scan takes only blobs with pairs the ledger lacks, each blob once however many
documents hold it, and joins all findings of the current pairs back to the
documents. Findings are written before the pairs, so a scan that breaks off is
repeated, and repeated findings count once.

A span is [start, end) in code points. Rules are regular expressions, found
leftmost and without overlap within a rule; matches whose measured group is too
short are dropped after the search.

Null texts count as empty and hold no span; their hash is that of no spans.
Repeated rows come back as often as they occur. Spans that start at one place are
ordered by kind. Very long texts are scanned whole, in one row of memory. Columns
of the documents may have any names: they travel in a struct. An empty table gives
an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, boxed, own_dir, sieve, sieved, table, written

#: kind, version, pattern, group measured, its least length. The first three are the base rules.
RULES = [
    ("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    ("github", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40),
    ("google", 1, r"AIza[A-Za-z0-9_-]{35,}", 0, 39),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("stripe", 1, r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 1),
]
BASE = 3
#: Session setting: a folder that keeps the ledger from run to run, for the query and the pipeline's stage alike.
LEDGER = "spark.terracurve.secrets.ledger"
_GAP = r"(?:\s|\\[nr]){0,8}"
#: The rules of redaction: a private key goes from its BEGIN line, over headers and the base64 body, to the END line or else to
#: the body's end. The query keeps the rules of its SQL, where the key's span is its BEGIN line.
WHOLE = [
    r if r[0] != "pem" else ("pem", 2, rf"{r[2]}(?:{_GAP}[A-Z][A-Za-z-]{{2,20}}:[^\r\n\\]*){{0,4}}(?:[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----|(?:{_GAP}[A-Za-z0-9+/=]{{16,}}){{0,1000}}(?:{_GAP}[A-Za-z0-9+/]{{1,15}}={{1,2}})?)", 0, 1)
    for r in RULES
]


def _pair(rule) -> str:
    return f"{rule[0]}@{rule[1]}"


def _rows(i: int, rule):
    """For each match of rule i: its place, the characters between it and the match before, its length, whether it is kept."""
    _, _, pattern, group, least = rule
    measured = F.col(f"_m{i}") if group == 0 else F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    size = lambda a: F.transform(a, lambda x: F.length(x))
    matches = F.arrays_zip(size(F.split("text", pattern, -1)).alias("gap"), size(F.col(f"_m{i}")).alias("len"), size(measured).alias("n"))
    row = lambda x, at: F.struct(F.lit(i).alias("kind"), at.alias("at"), x["gap"].alias("gap"), x["len"].alias("len"), (x["n"] >= least).alias("ok"))
    return F.when(F.size(f"_m{i}") > 0, F.transform(F.slice(matches, F.lit(1), F.size(f"_m{i}")), row))


def found_in(texts: DataFrame, rules=RULES) -> DataFrame:
    """blob, kind (place in RULES), pair, start, end. ``texts``: blob, text, todo (pairs to scan for)."""
    df = texts
    for i, rule in enumerate(rules):
        df = df.withColumn(f"_m{i}", F.when(F.array_contains("todo", _pair(rule)), F.regexp_extract_all("text", F.lit(rule[2]), F.lit(0))))
    each = [_rows(i, rule) for i, rule in enumerate(rules)]
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,len:int,ok:boolean>>")
    rows = df.select("blob", F.explode(F.flatten(F.array(*(F.coalesce(x, none) for x in each)))).alias("m")).select("blob", "m.*")
    so_far = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).where("ok")
    pairs = F.array(*(F.lit(_pair(r)) for r in rules))
    return rows.select("blob", "kind", F.get(pairs, "kind").alias("pair"), (F.col("end") - F.col("len")).alias("start"), "end")


def _todo(blobs: DataFrame, seen: DataFrame | None, rules) -> DataFrame:
    """blob, todo (the pairs that the ledger lacks), lone (no copy at hand, and all pairs lacking) of the blobs that lack any. ``blobs``: blob."""
    pairs = F.array(*(F.lit(_pair(r)) for r in rules))
    own = blobs.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    if seen is None:
        return own.select("blob", pairs.alias("todo"), (F.col("n") == 1).alias("lone"))
    known = seen.groupBy(F.col("blob").alias("_known")).agg(F.flatten(F.collect_set("pairs")).alias("pairs"))
    met = own.join(known, F.col("blob") == F.col("_known"), "left")
    met = met.withColumn("todo", F.array_except(pairs, F.coalesce("pairs", F.array().cast("array<string>"))))
    return met.where(F.size("todo") > 0).select("blob", "todo", ((F.col("n") == 1) & (F.size("todo") == len(rules))).alias("lone"))


def _unseen(docs: DataFrame, todo: DataFrame, rules) -> DataFrame:
    """blob, text, todo: the texts to scan.

    Bitmaps of blobs, of a fixed size, tell in place which rows certainly lack nothing, and which ones certainly are
    lone; these are scanned where they lie. Only the rest is shuffled, so that each blob that has copies is scanned once.
    """
    bits = sieve(todo, F.col("blob"), wanted=F.lit(True), shared=~F.col("lone"))
    rows = docs.select(_blob().alias("blob"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = sieved(rows, bits, F.col("blob"), "wanted", "shared").where("wanted")
    lone = rows.where("not shared").select("blob", "text", F.array(*(F.lit(_pair(r)) for r in rules)).alias("todo"))
    shared = rows.where("shared").groupBy("blob").agg(F.first("text").alias("text"))
    return lone.unionByName(shared.join(todo, "blob").select("blob", "text", "todo"))


def scan(docs: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """Scans what the ledger (a folder) lacks, adds it, and returns the findings in ``docs`` for the current rules: blob, kind, start, end."""
    spark = docs.sparkSession
    blobs = written(docs.select(_blob().alias("blob")), "blobs")
    todo = written(_todo(blobs, _read(spark, f"{ledger}/seen", "blob binary, pairs array<string>"), rules), "todo")
    # Findings come before the pairs, so that a scan that breaks off is repeated.
    found_in(_unseen(docs, todo, rules), rules).write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", F.col("todo").alias("pairs")).write.mode("append").parquet(f"{ledger}/seen")
    found = _read(spark, f"{ledger}/findings", "blob binary, kind int, pair string, start bigint, end bigint")
    kinds = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(_pair(r)), F.lit(i))))
    found = found.withColumn("kind", kinds[F.col("pair")]).where(F.col("kind").isNotNull()).select("blob", "kind", "start", "end").distinct()
    return found.join(blobs.distinct(), "blob", "left_semi")  # counted where they lie, so that the copies of a text don't meet in one task


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """None if there is no such folder yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def by_blob(found: DataFrame, rules=RULES) -> DataFrame:
    """One row for each blob with findings: its spans, sorted by start, then kind, and the base counts."""
    one = F.struct("start", "kind", "end")
    return found.groupBy("blob").agg(F.sort_array(F.collect_list(one)).alias("found"), *(F.count_if(F.col("kind") == i).alias(f"n_{rules[i][0]}") for i in range(BASE)))


def ledger_of(spark: SparkSession) -> str:
    """The folder that the session names in ``LEDGER``, which later runs go on with; else a new one of this application."""
    return spark.conf.get(LEDGER, None) or f"{own_dir(spark)}/ledger-{uuid.uuid4().hex}"


def _blob() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def _findings(docs: DataFrame, ledger: str | None, rules) -> DataFrame:
    """One row for each blob with findings: _blob, found and the base counts."""
    found = scan(docs, ledger or ledger_of(docs.sparkSession), rules)
    return written(by_blob(found, rules).withColumnRenamed("blob", "_blob"), "spans")


def secrets(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    df = beside(docs.select("doc_id", _blob().alias("_b")), _findings(docs, ledger, rules), F.col("_b") == F.col("_blob"))
    kinds = F.array(*(F.lit(r[0]) for r in rules))
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = text(F.filter(found, lambda s: s["kind"] < BASE))
    counts = (F.coalesce(f"n_{r[0]}", F.lit(0)).cast("long").alias(f"n_{r[0]}") for r in rules[:BASE])
    return df.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), text(found).alias("spans"))


def redacted(docs: DataFrame, ledger: str | None = None, rules=WHOLE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, overlapping ones joined, replaced by ``mark``, and n_chars set to the new length."""
    df = beside(boxed(docs, "text", _blob().alias("_b")), _findings(docs, ledger, rules), F.col("_b") == F.col("_blob"))
    piece = lambda a, b: F.substr(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    # A span that starts before the last one's end only moves the end on.
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= F.greatest(a["at"], F.lit(1)), F.concat(a["out"], piece(a["at"], s["start"]), F.lit(mark))).when((a["at"] == 0) & (s["start"] == 0), F.lit(mark)).otherwise(a["out"]).alias("out"))
    text = F.aggregate("found", start, step, lambda a: F.concat(a["out"], piece(a["at"], F.length("text"))))
    new = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length(text).cast("long"))
    return df.select(F.when(F.col("found").isNotNull(), new).otherwise(F.col("_row")).alias("_row")).select("_row.*")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = " union all ".join(
        f"""select doc_id, {i} kind, '{name}' name, at, length(m[at])::bigint n, length(g[at]) >= {least} ok, length(gaps[at])::bigint gap from (
 select doc_id, m, g, gaps, unnest(range(1, len(m) + 1)) at from (select doc_id, regexp_extract_all(t, {quoted(pattern)}, 0) m, regexp_extract_all(t, {quoted(pattern)}, {group}) g,
 regexp_split_to_array(t, {quoted(pattern.replace("([", "(?:[") if group else pattern)}) gaps from d))"""
        for i, (name, _, pattern, group, least) in enumerate(RULES)
    )
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
r as ({each.replace(" at,", " pos,").replace("[at]", "[pos]").replace(" at from", " pos from")}),
e as (select *, sum(gap + n) over (partition by doc_id, kind order by pos) stop from r),
s as (select doc_id, kind, name, (stop - n)::bigint start, stop::bigint stop from e where ok),
a as (select doc_id, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
 string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3) base, string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) spans from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join a using (doc_id)
"""


SQL = _sql()
