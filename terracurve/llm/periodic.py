"""Periodic runs of words, by maximal pairs in the tree of LCP intervals.

A run is a stretch of words with smallest period q, ``length >= EXPONENT * q`` and
``length >= LEAST``, that no word beside it extends. A pair of places i < j whose
longest common extension has l words, with different words before them, is maximal;
it shows the run that starts at i, with period j - i and l + j - i words, if l is
at least ``EXPONENT - 1`` periods. So no run has to be extended.

The suffixes of a text are sorted by doubling, and the LCP intervals are walked
bottom up. An interval holds its places with their left-word classes; where two
children meet, places of different class within the distance pair up. Two such places
of a common string of twice their distance or more have none of the interval between
them unless the period is a smaller one, so the class lists are kept as one
list in order of place, in which pairs are neighbours: a new place looks at two others
only, whatever the number of classes. The shorter list goes into the longer one. Intervals
that are too short for any run aren't built, and a text none of whose word groups of
that length is repeated isn't sorted at all.

Each row is a text of its own, so nothing is shuffled. Null texts count as empty and have
no runs. Rows without doc_id and repeated rows are kept as they are. Very long texts are
read whole, in one task each. Columns besides doc_id and text aren't read, whatever their
names. Runs are ordered by start, then period. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

EXPONENT, LEAST = 4, 6
#: Bytes of collapsed texts that go back to Spark at a time.
OUT_BYTES = 16 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def least_common(exponent: int, least: int) -> int:
    """The fewest words that the two places of a run's pair can have in common."""
    common = exponent - 1
    while common + common // (exponent - 1) < least:
        common += 1
    return common


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _repeats(codes: np.ndarray, size: int) -> bool:
    """False if certainly no ``size`` words in a row stand twice in the text."""
    m = len(codes) - size + 1
    if m < 2:
        return False
    h = np.zeros(m, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + m].astype(np.uint64)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``codes`` in order, and how many words each has in common with the next one."""
    n = len(codes)
    levels, size = [_dense(codes)], 1
    while size < n and levels[-1].max() + 1 < n:
        key = levels[-1] * (n + 1)
        key[:-size] += levels[-1][size:] + 1
        levels.append(_dense(key))
        size *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, dtype=np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        size = 1 << depth
        fits = np.flatnonzero(np.maximum(a, b) + size <= n)
        same = fits[levels[depth][a[fits]] == levels[depth][b[fits]]]
        for x in (a, b, common):
            x[same] += size
    return order, common


def _met(many: list[int], few: list[int], common: int, reach: int, left: list[int], out: list[tuple[int, int, int]]) -> list[int]:
    """Places of two children of an interval in one list; the pairs between them go to ``out``."""
    if len(many) < len(few):
        many, few = few, many
    own = ()
    if len(few) == 1:
        many.insert(bisect_left(many, few[0]), few[0])
    elif len(few) * 16 < len(many):
        own = set(few)
        for x in few:
            many.insert(bisect_left(many, x), x)
    else:
        own, many = set(few), sorted(many + few)
    for x in few:
        k = bisect_left(many, x)
        if k:
            y = many[k - 1]
            if x - y <= reach and left[x] != left[y] and y not in own:
                out.append((y, common + x - y, x - y))
        if k + 1 < len(many):
            y = many[k + 1]
            if y - x <= reach and left[x] != left[y] and y not in own:
                out.append((x, common + y - x, y - x))
    return many


def runs(codes: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length, period of every run, by start, then period. ``exponent`` is 3 at least."""
    shortest = least_common(exponent, least)
    if not _repeats(codes, shortest):
        return []
    order, common = suffixes(codes)
    left = [-1, *codes.tolist()]  # no word stands before the first
    out: list[tuple[int, int, int]] = []
    deep = np.flatnonzero(common >= shortest)
    for part in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        if not len(part):
            continue
        places, depths = order[part[0] : part[-1] + 2].tolist(), common[part[0] : part[-1] + 1].tolist()
        open_: list[tuple[int, list[int]]] = []  # intervals whose last child is still to come, the deepest one last
        for place, depth in zip(places, [*depths, -1], strict=True):
            child = [place]
            while open_ and open_[-1][0] >= depth:
                at, held = open_.pop()
                child = _met(held, child, at, at // (exponent - 1), left, out)
            open_.append((depth, child))
    return sorted(x for x in out if x[1] >= least)


def collapsed(found: list[bytes], repeats: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not repeats:
        return found
    edge = np.zeros(len(found) + 1, dtype=np.int64)
    for start, length, period in repeats:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [found[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _scanned(batches: Iterator[pa.RecordBatch], exponent: int, least: int) -> Iterator[pa.RecordBatch]:
    def out(rows) -> pa.RecordBatch:
        ids, counts, repeats, texts = zip(*rows, strict=True)
        ends = np.cumsum([0, *map(len, repeats)]).astype(np.int32)
        flat = np.array([x for own in repeats for x in own], dtype=np.int64).reshape(-1, 3)
        each = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(_RUN))
        columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), each), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    for batch in batches:
        rows, size = [], 0
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            found = text.as_buffer().to_pybytes().split() if text.is_valid else []  # of bytes: ASCII white space only
            number: dict[bytes, int] = {}
            codes = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
            repeats = runs(codes, exponent, least)
            rows.append((doc_id.as_py(), len(found), repeats, b" ".join(collapsed(found, repeats))))
            size += len(rows[-1][3])
            if size >= OUT_BYTES:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and collapsed: the text's words, joined by a space, without the repetitions of runs."""
    if exponent < 3:
        raise ValueError("pairs of neighbours show runs of three periods or more")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return texts.mapInArrow(lambda batches: _scanned(batches, exponent, least), SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text; in a tenth of the documents, by the CRC of doc_id, the words from some place on repeat the first ones from there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Whole words once a row: two columns that are used several times aren't inlined.
    df = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    df = df.withColumn("n", F.coalesce(F.size("w"), F.lit(-1))).withColumn("g", F.expr("h div 10"))
    df = df.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    df = df.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    unit = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.expr("cast((n - a + p - 1) div p as int)"))), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return df.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query from those of ``periodic_runs``."""
    over = lambda b, r: r["length"] * b["period"] > b["length"] * r["period"]
    top = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(over(b, r), r).otherwise(b))
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    df = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("_top"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * _top.length) div _top.period")
    return df.select("doc_id", "n_runs", *(F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
