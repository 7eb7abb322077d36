"""License scan with a positional index of rare words.

Each template has a mandatory key phrase. The index maps the rarest words of each
phrase (by document frequency in the corpus) to their places (template,
position); as a match must hold the whole phrase, these are the highest-IDF words
of a file that can tell where a template lies, and no other word could add a
match. Each of their places in a text votes for (template, place of the
template's first word). Where at least two words agree on the relative position,
the template is laid over the text: its mandatory words must all match, and the
share of all its words that match is the score. Every template is looked up by
its own words, so licences that share a text don't displace each other, and every
place where a phrase stands is found.

Everything after the corpus count happens within a row, so no text is shuffled.
The count has one row for each word of the templates, so it goes to the driver.

Null texts count as empty: no words, no labels, score 0. Repeated rows come
back as often as they occur. Words of equal frequency rank by code point. Very long
texts are scanned whole, in one row of memory. Only doc_id and text are read, so
other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: label, words, mandatory phrase.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: Rare words of a phrase that are looked up, and how many of them must agree; the share of a template's words that must match.
RARE, AGREE, LEAST = 2, 2, 0.6
#: Places of the text's words are shifted by this in packed longs, so that a template may begin before the text.
SHIFT = 1 << 32


def _templates(templates) -> list[tuple[str, list[str], list[int]]]:
    """label, words, mandatory positions."""
    out = []
    for label, text, phrase in templates:
        w, p = text.split(), phrase.split()
        at = next(i for i in range(len(w)) if w[i : i + len(p)] == p)
        out.append((label, w, list(range(at, at + len(p)))))
    return out


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Of each word of the templates, over all documents."""
    own = docs.select(F.explode(F.array_intersect(words(F.col("text")), _strings(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def _all_in(values: list[str], column: str) -> Column:
    out = F.lit(True)
    for v in dict.fromkeys(values):
        out = out & F.array_contains(column, v)
    return out


def _places(ws: list[str]) -> Column:
    """Where the words stand consecutively in ``_w``."""

    def here(w, i):
        fits = w == ws[0]
        for j in range(1, len(ws)):
            fits = fits & (F.get(F.col("_w"), i + j) == ws[j])
        return F.when(fits, i)

    found = F.filter(F.transform("_w", here), lambda i: i.isNotNull())
    return F.when(_all_in(ws, "_has"), found).otherwise(F.array().cast("array<int>"))


def rarest(words_of: list[str], df_of: dict[str, int], n: int = RARE) -> list[str]:
    """The distinct words of highest IDF, ties by code point."""
    return sorted(set(words_of), key=lambda w: (df_of.get(w, 0), w))[:n]


def licensed(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    built = _templates(templates)
    base = [(p.split(), label) for p, label in BASE]
    vocabulary = sorted({ws[i] for _, ws, must in built for i in must} | {w for ws, _ in base for w in ws})
    df_of = document_frequencies(docs, vocabulary)
    postings: dict[str, list[int]] = {}
    for t, (_, ws, must) in enumerate(built):
        for w in rarest([ws[i] for i in must], df_of):
            for j in must:
                if ws[j] == w:  # plus a place in the text gives template and first word
                    postings.setdefault(w, []).append(t * 2 * SHIFT + SHIFT - j)

    df = docs.select("doc_id", words(F.col("text")).alias("_w"))
    df = df.select("doc_id", "_w", F.array_intersect("_w", _strings(vocabulary)).alias("_has"))
    # Places of the base phrases, where all words of one occur at all.
    places = [_places(ws) for ws, _ in base]
    # Rare words are looked up only where the mandatory words of some template occur.
    gate = F.lit(False)
    for _, ws, must in built:
        gate = gate | _all_in([ws[i] for i in must], "_has")
    df = df.select("doc_id", "_w", *(p.alias(f"_p{i}") for i, p in enumerate(places)), gate.alias("_gate"))
    index = F.create_map(*(x for w, ps in postings.items() for x in (F.lit(w), F.array(*(F.lit(p) for p in ps)).cast("array<bigint>"))))
    rare = F.array_compact(F.transform("_w", lambda w, i: F.when(w.isin(list(postings)), F.struct(w.alias("w"), i.alias("i")))))
    votes = F.flatten(F.transform(rare, lambda a: F.transform(index[a["w"]], lambda p: p + a["i"])))
    df = df.withColumn("_v", F.when(F.col("_gate"), F.sort_array(votes))).drop("_gate")
    agreed = F.array_distinct(F.filter("_v", lambda x, i: F.get(F.col("_v"), i + AGREE - 1) == x))
    texts = F.array(*(_strings(ws) for _, ws, _ in built))
    musts = F.array(*(F.array(*(F.lit(i) for i in must)) for _, _, must in built))
    labels = _strings(label for label, _, _ in built)

    def laid(x):
        t, first = F.floor(x / (2 * SHIFT)).cast("int"), (F.pmod(x, F.lit(2 * SHIFT)) - SHIFT).cast("int")
        own = F.get(texts, t)
        fits = lambda j, w: F.coalesce(F.get(F.col("_w"), first + j) == w, F.lit(False))
        n = F.size(F.filter(own, lambda w, j: fits(j, w)))
        sure = F.forall(F.get(musts, t), lambda j: fits(j, F.get(own, j)))
        return F.struct(F.get(labels, t).alias("label"), F.when(sure, n / F.size(own)).otherwise(0.0).alias("score"))

    df = df.withColumn("_c", agreed)
    seen = F.filter(F.transform("_c", laid), lambda s: s["score"] >= LEAST)
    df = df.withColumn("_s", F.coalesce(F.when(F.size("_c") > 0, seen), F.array().cast("array<struct<label:string,score:double>>")))
    df = df.withColumn("_all", F.concat(*(F.col(f"_p{i}") for i in range(len(base)))))
    df = df.withColumn("_base", F.filter(F.array(*(F.when(F.size(f"_p{i}") > 0, label) for i, (_, label) in enumerate(base))), lambda x: x.isNotNull()))
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return df.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"), F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"),
        joined(F.col("_base")).alias("base_labels"), joined(F.concat("_base", F.transform("_s", lambda s: s["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("_s", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed(table(spark, sf_dir, "documents"))


def _sql() -> str:
    built, rows = _templates(TEMPLATES), []
    for t, (label, ws, must) in enumerate(built):
        rows += [f"({t}, '{label}', {j}, '{w}', {str(j in must).lower()}, {len(ws)})" for j, w in enumerate(ws)]
    base = " union all ".join(
        f"select a.doc_id, a.i, '{label}' label from w a " + " ".join(f"join w b{j} on b{j}.doc_id = a.doc_id and b{j}.i = a.i + {j} and b{j}.w = '{x}'" for j, x in enumerate(p.split()[1:], 1)) + f" where a.w = '{p.split()[0]}'"
        for p, label in BASE
    )
    more = ", ".join(f"('{w}')" for w in sorted({w for p, _ in BASE for w in p.split()}))
    return rf"""
with t(t, label, j, word, must, n) as (values {", ".join(rows)}),
d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from documents),
w as (select doc_id, unnest(range(len(ws))) i, unnest(ws) w from d),
voc as (select word from t where must union select * from (values {more})),
df as (select w, count(distinct doc_id) df from w where w in (select word from voc) group by w),
rare as (select t, word from (select t, word, row_number() over (partition by t order by coalesce(df, 0), word) k from (select distinct t, word from t where must) left join df on w = word) where k <= {RARE}),
look as (select t.t, t.j, t.word from t join rare using (t, word) where must),
votes as (select w.doc_id, l.t, w.i - l.j first from w join look l on l.word = w.w group by all having count(*) >= {AGREE}),
laid as (select v.doc_id, v.first, t.t, t.label, count(*) filter (w.w = t.word) / max(t.n)::double score, bool_and(not t.must or coalesce(w.w = t.word, false)) sure
 from votes v join t using (t) left join w on w.doc_id = v.doc_id and w.i = v.first + t.j group by all),
s as (select doc_id, label, score from laid where sure and score >= {LEAST}),
b as ({base}),
ba as (select doc_id, count(*) n_base, min(i) first_word, max(i) last_word, string_agg(distinct label, ',' order by label) base_labels from b group by doc_id),
la as (select doc_id, string_agg(distinct label, ',' order by label) labels from (select doc_id, label from b union all select doc_id, label from s) group by doc_id),
sa as (select doc_id, max(score) score from s group by doc_id)
select d.doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::double score
from d left join ba using (doc_id) left join la using (doc_id) left join sa using (doc_id)
"""


SQL = _sql()
