"""Exact top-k search by inner product, with a KD-tree in every shard.

Vectors are dealt by hash into shards. A shard's tree halves its vectors at the
median of the widest dimension and keeps tight bounding boxes; ties in that
dimension are cut by rank, so equal vectors do no harm. A query goes through a
tree best-first: the largest inner product that a box allows orders the nodes,
and the search of a tree ends when no box left can reach the kth score so far.

The first pass searches, for each query, one shard only. Its kth score is a
bound that the second pass carries to all other shards, so their trees start
with it. Queries travel in blocks: a task holds one shard and one block, whose
sizes are parameters. Each shard returns at most k rows a query, and the last
step keeps the best k of them, ties to the smaller vec_id.

A block of queries is large, as every shard is sent once to each: vectors travel
once for every ``every * BLOCK_ROWS`` of them, so the bytes sent grow with the
square of the vectors, like the comparisons of an exact search whose boxes don't
prune; the sample's boxes, in 64 dimensions, don't.

Components are floor(256 * x). Vectors that are null or hold a null or
non-finite component, and rows without vec_id, take no part. Every row is a
candidate and, if its id is due, a query of its own, repeated vec_ids included; only
the query's own row is left out. Ties go to the smaller vec_id. Vectors of different
length aren't compared, empty ones have no scores above 0. Very long vectors are compared
whole. Scores outside the range of a long are held at its ends. Other columns are
not read, so they may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 16_384, 256
QUERY_EVERY, K = 50, 5
EXACT = 2.0**53


class Tree:
    """Nodes in arrays: children, row range, box. Rows are in tree order."""

    def __init__(self, ids: np.ndarray, rows_: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        parts, todo = [order], [(0, 0)]  # todo: node, first row
        n_nodes, placed = 1, np.empty(len(ids), dtype=np.int64)
        self.left, self.start, self.end = [-1], [0], [len(ids)]
        lows, highs = [x.min(axis=0)], [x.max(axis=0)]
        while todo:
            node, at = todo.pop()
            rows = parts[node]
            if len(rows) <= LEAF_ROWS:
                placed[at : at + len(rows)] = np.sort(rows)
                continue
            dim = int(np.argmax(highs[node] - lows[node]))
            half = len(rows) // 2
            cut = np.argpartition(x[rows, dim], half)
            self.left[node] = n_nodes
            for part, first in ((rows[cut[:half]], at), (rows[cut[half:]], at + half)):
                parts.append(part)
                self.left.append(-1)
                self.start.append(first)
                self.end.append(first + len(part))
                lows.append(x[part].min(axis=0))
                highs.append(x[part].max(axis=0))
                todo.append((n_nodes, first))
                n_nodes += 1
            parts[node] = None
        self.ids, self.rows, self.x = ids[placed], rows_[placed], x[placed]
        self.lows, self.highs = np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.highs.T + np.minimum(queries, 0) @ self.lows.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The (score, -id) of the best k rows that reach ``floor``, best first."""
        best: list[tuple[float, int]] = []
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if -most < floor or (len(best) == k and -most < best[0][0]):
                break
            child = self.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    heapq.heappush(heap, (-bound[c], c))
                continue
            part = slice(self.start[node], self.end[node])
            ids, scores = self.ids[part], self.x[part] @ query
            scores[self.rows[part] == own] = -np.inf
            least = max(floor, best[0][0] if len(best) == k else floor)
            near = np.flatnonzero(scores >= least)
            if len(near) > k:  # the kth score here, and all rows that tie with it: ids ascend in a leaf
                near = near[np.lexsort((ids[near], -scores[near]))[: k + 1]]
            for i in near:
                if scores[i] == -np.inf:
                    continue
                item = (scores[i], -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(best, reverse=True)


def _exact(x: np.ndarray, q: np.ndarray) -> bool:
    most = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0))
    return float(most) * float(most) * x.shape[1] < EXACT


def _plain(ids: np.ndarray, rows_: np.ndarray, x: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Whole-number arithmetic for components so large that doubles would round."""
    rows = [[int(v) for v in r] for r in x]
    for i, q in enumerate(queries):
        q = [int(v) for v in q]
        found = ((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, r, strict=True)))), -int(j)) for j, n, r in zip(ids, rows_, rows, strict=True) if n != own[i])
        yield i, heapq.nlargest(k, found)


def search_block(key, vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of one shard for each query of one block."""
    out = []
    if len(vectors) and len(queries):
        x, q = np.stack(vectors["v"].to_list()).astype(np.float64), np.stack(queries["v"].to_list()).astype(np.float64)
        ids, numbers, own, floor = vectors["vec_id"].to_numpy(), vectors["row"].to_numpy(), queries["row"].to_numpy(), queries["floor"].to_numpy(dtype=np.float64)
        if x.shape[1] and _exact(x, q):
            tree = Tree(ids, numbers, x)
            bounds = tree.bounds(q)
            found = ((i, tree.search(q[i], own[i], bounds[i], k, floor[i])) for i in range(len(q)))
        else:
            found = _plain(ids, numbers, x, q, own, k)
        for i, best in found:
            out += [(own[i], -j, int(s)) for s, j in best]
    return pd.DataFrame(out, columns=["query", "vec_id", "score"]).astype("int64")


def _whole(e):
    """floor(256 * x) as a double; beyond 2**53 every double is whole already."""
    y = F.lit(256.0) * e.cast("double")
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *more: Column) -> DataFrame:
    """row (a number of its own), vec_id, v (array<double> of whole numbers), ``more``, dim."""
    x = F.col(vec_col)
    good = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: _whole(e))
    return vectors.where(good).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), v.alias("v"), *more).withColumn("dim", F.size("v"))


def topk(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score."""
    x = written(usable(vectors, id_col, vec_col), "vectors")  # written once, so row numbers stay
    n = x.count()
    shards, blocks = -(-n // SHARD_ROWS) or 1, -(-n // (every * BLOCK_ROWS)) or 1
    data = x.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    asks = x.select(*(F.col(c).alias(c) for c in x.columns)).where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int"))
    schema = "query long, vec_id long, score long"
    names = ["row", "vec_id", "v", "dim", "shard", "block"]

    def searched(queries: DataFrame, each: DataFrame) -> DataFrame:
        """queries: ``names`` and floor. each: the vectors with shard and block."""
        keys = ["dim", "shard", "block"]
        return each.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(lambda key, a, b: search_block(key, a, b, k), schema)

    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    first = asks.withColumn("shard", home).withColumn("floor", F.lit(float("-inf")))
    met = data.withColumn("block", spread).where(F.col("shard") == home)
    seeds = written(searched(first.select(*names, "floor"), met.select(*names)), "topk-seeds")
    kth = seeds.groupBy("query").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query", F.col("s").cast("double").alias("kth"))
    others = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    others = others.join(kth, F.col("row") == F.col("query"), "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf"))))
    rest = searched(others.select(*names, "floor"), data.withColumn("block", spread).where(F.col("shard") != home).select(*names))
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = seeds.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    ids = asks.select(F.col("row").alias("_row"), F.col("vec_id").alias("query_id"))
    return best.join(ids, F.col("query") == F.col("_row")).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(table(spark, sf_dir, "embeddings"))


SQL = """
with v as (select row_number() over () n, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
e as (select n, vec_id, unnest(v) x, unnest(range(len(v))) i from v),
s as (select q.n qn, c.n cn, any_value(q.vec_id) query_id, any_value(c.vec_id) vec_id, sum(q.x * c.x)::bigint score from e q join e c on q.i = c.i and q.n <> c.n where q.vec_id % 50 = 0 group by q.n, c.n),
r as (select *, row_number() over (partition by qn order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
