"""Packing: optimal length buckets and token-budget batches.

Lengths (words) are counted in a global histogram, one row for each length that
occurs, at every size of the input: there are no more of them than the longest text has words,
nor than the root of twice all words. Dynamic
programming over it finds the bucket boundaries with the least total padding, in
at most buckets * lengths * log(lengths) steps.
Within a bucket documents are shuffled by a seeded key and numbered without gaps;
every ``budget // boundary`` of them, at least one, form a batch.

Null or empty texts have length 0 and fall into the first bucket. A document
longer than the budget is a batch of its own. Repeated rows are packed each, ties
in any order. Rows without doc_id are shuffled by their text. Only doc_id and text
are read, so other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_total, shuffle_key, table, words, written

BUCKETS, BUDGET, SEED = 16, 65_536, 29


def boundaries(most: list[int], count: list[int], total: list[int], buckets: int) -> list[int]:
    """Greatest lengths of the buckets, ascending, with the least sum of boundary minus length.

    ``most`` are lengths in order, with the rows of each and the sum of
    their lengths. ``best[j]`` is the least cost of lengths before j. Costs are
    exact while they stay under 2**63, and rows times length does so in practice.
    """
    h = len(most)
    if not h:
        return []
    rows, sums, top = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)]), np.asarray(most, dtype=np.int64)
    far = np.iinfo(np.int64).max // 4
    best, cuts = np.full(h + 1, far, dtype=np.int64), []
    best[0] = 0
    for _ in range(min(buckets, h)):
        now, cut = np.full(h + 1, far, dtype=np.int64), np.zeros(h + 1, dtype=np.int64)
        # The best first length of the last bucket moves up with its end (the costs obey the quadrangle inequality), so halves are solved within bounds.
        todo = [(1, h, 0, h - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + top[j - 1] * (rows[j] - rows[i]) - (sums[j] - sums[i])
            cut[j] = first + int(np.argmin(cost))
            now[j] = cost[cut[j] - first]
            todo += [(lo, j - 1, first, int(cut[j])), (j + 1, hi, int(cut[j]), last)]
        cuts.append(cut)
        best = now
    found, j = [], h
    for cut in reversed(cuts):
        found.append(int(top[j - 1]))
        j = int(cut[j])
    return found[::-1]


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, count: one row for each length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("count"))


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_to, batch, slot, padding of every document."""
    key = shuffle_key(seed)
    lengths = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_tokens"), key.alias("key")).withColumn("slice", F.substring("key", 1, 3))
    lengths = written(lengths, "pack-lengths")
    each = histogram(lengths).orderBy("n_tokens").collect()  # bounded: see above
    tops = boundaries([r["n_tokens"] for r in each], [r["count"] for r in each], [r["n_tokens"] * r["count"] for r in each], buckets)
    edges = F.array(*(F.lit(x) for x in tops)).cast("array<bigint>")
    df = lengths.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))).withColumn("padded_to", F.get(edges, F.col("bucket")))
    df = running_total(df, ["bucket", "padded_to"], "slice", ["key", "doc_id", "n_tokens"], F.lit(1), "rank")
    df = df.withColumn("_each", F.greatest(F.expr(f"{budget} div greatest(padded_to, 1)"), F.lit(1)).cast("long"))
    return df.select("doc_id", "n_tokens", "bucket", "padded_to", F.expr("rank div _each").alias("batch"), F.expr("rank % _each").alias("slot"), (F.col("padded_to") - F.col("n_tokens")).alias("padding"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
