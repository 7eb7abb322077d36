"""Hard negatives for contrastive training: shared lists of anchor clusters.

Anchors are dealt to clusters of like direction. For a cluster and a shard of the
vectors, the shard's rows are sorted once by the most that any member could score a unit of its
length: the row's norm times the cosine of its angle to the cluster's centre, less the
largest angle of a member. Every member walks that one list from the top, some hundred
rows at a time. It stops where the bound of the next row is below what it still looks for, so what it
has then is certainly whole. With centres that don't fit, members walk further; they never miss a row.

Two walks: for the ``positives`` best rows of the anchor's own label, and, for each of these, for the
best rows of other labels whose score is at least ``low`` and at most ``high`` percent of the positive's.
A shard's walk starts from the score that an anchor's first shard gave (its last positive, or
last negative in each window), which is carried over to all others. Shards and blocks of
anchors have sizes of their own; labels and clusters deal nothing out, so a frequent label,
a frequent vector or a large cluster makes no task larger. A shard returns at most ``positives`` rows an anchor,
and ``negatives`` a window. All shards are sent to each block of anchors once or twice, so vectors travel
twice for every ``every * BLOCK_ROWS`` of them. How far members walk depends on the vectors: in many dimensions without
clusters angles are near a right one, and the bounds exclude little.

Centres are those of k-means by angle on ``SAMPLE`` anchors at most, the first ones by hash; they decide
how far members walk, not what they find.

Components are floor(256 * x). Rows without label, without vec_id, with a null vector or a null or
non-finite component take no part. Rows count one by one, repeated vec_ids included; only the anchor's own row isn't its
partner. Higher scores come first, ties by the smaller vec_id, repeated rows beyond that in any order, as they
return the same values. Vectors of different length aren't compared; empty ones have score 0. Positives
of a negative score have no window that any score fits. Scores whose sums doubles can't hold exactly are added as whole
numbers, row by row, and held at the ends of a long. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .topk import EXACT, usable

SHARD_ROWS, BLOCK_ROWS = 8192, 16_384
#: Anchors that centres are fitted on at most, clusters at most, anchors for each cluster at least, rounds of k-means.
SAMPLE, CLUSTERS, CLUSTER_ROWS, ROUNDS = 8192, 128, 32, 8
#: Rows of a list that members score at a time (a power of two), and members that walk together.
STEP, WALKERS = 512, 1024
EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 50, 5, 3, 50, 95
NONE = np.iinfo(np.int64).min
_FOUND = "anchor long, slot int, place long, vec_id long, score long"


def centres(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means by angle; starts with every len(x) / n-th row."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = unit[np.arange(n) * len(unit) // n]
    for _ in range(rounds):
        of = (unit @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def _angles(x: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((x @ centre) / np.maximum(norms, 1e-300), -1, 1))


class Shared:
    """The list of one cluster: rows of a shard by what a member could score a unit of its length."""

    def __init__(self, x: np.ndarray, norms: np.ndarray, members: np.ndarray, member_norms: np.ndarray):
        unit = members / np.maximum(member_norms[:, None], 1e-300)
        centre = unit.sum(axis=0)
        centre /= max(np.linalg.norm(centre), 1e-300)
        wide = _angles(members, member_norms, centre).max() if centre.any() else np.pi
        near = np.maximum(_angles(x, norms, centre) - wide, 0)
        bound = norms * np.cos(near) if centre.any() else norms
        bound = bound + norms * 1e-6  # far more than what rounding takes from an angle near zero
        self.order = np.argsort(-bound, kind="stable")
        self.bound = np.append(bound[self.order], -np.inf)


def _best(scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, places: np.ndarray, top: tuple, k: int) -> tuple:
    """The k best of ``top`` (scores, ids, places: one row a member) and of a step's scores, which are in order of id."""
    n = scores.shape[1]
    key = np.where(ok, scores * STEP + (STEP - 1 - np.arange(n)), NONE)
    at = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), (len(key), n))
    new = np.where(np.take_along_axis(key, at, 1) == NONE, NONE, np.take_along_axis(scores, at, 1))
    s, i, p = np.concatenate([top[0], new], 1), np.concatenate([top[1], ids[at]], 1), np.concatenate([top[2], places[at]], 1)
    order = np.lexsort((i, -np.maximum(s, NONE + 1)), axis=1)[:, :k]
    return tuple(np.take_along_axis(a, order, 1) for a in (s, i, p))


def _empty(n: int, k: int) -> tuple:
    return np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)


def _walk(shared: Shared, shard: dict, asks: dict, windows: int, k: int) -> tuple[list[tuple], int]:
    """Best k of every window for the members ``asks``; and the rows that were scored.

    asks: x, norm, row, label, and for each window the least and the largest score (``low`` and ``high``: one column a window).
    Windows 0: rows of the own label from ``low`` on.
    """
    m, slots = len(asks["row"]), max(windows, 1)
    tops, walking, scored = [_empty(m, k) for _ in range(slots)], np.arange(m), 0
    low, high = asks["low"], asks["high"]
    for at in range(0, len(shared.order), STEP):
        # A window is settled once no row to come reaches its kth score, or its least.
        need = np.stack([np.maximum(t[0][walking, k - 1], low[walking, s]) for s, t in enumerate(tops)], 1)
        need = np.where(high[walking] < low[walking], np.iinfo(np.int64).max, need)
        walking = walking[asks["norm"][walking] * shared.bound[at] + 1 >= need.min(axis=1)]
        if not len(walking):
            break
        rows = shared.order[at : at + STEP]
        rows = rows[np.argsort(shard["id"][rows], kind="stable")]
        scores = (asks["x"][walking] @ shard["x"][rows].T).astype(np.int64)
        scored += scores.size
        like = shard["label"][rows][None, :] == asks["label"][walking][:, None]
        for s in range(slots):
            ok = (scores >= low[walking, s, None]) & (scores <= high[walking, s, None])
            ok &= ~like if windows else like & (shard["row"][rows][None, :] != asks["row"][walking][:, None])
            due = np.flatnonzero(ok.any(axis=1))
            if len(due):
                top = _best(scores[due], ok[due], shard["id"][rows], shard["row"][rows], tuple(a[walking[due]] for a in tops[s]), k)
                for a, b in zip(tops[s], top, strict=True):
                    a[walking[due]] = b
    return tops, scored


def _plain(shard: dict, asks: dict, windows: int, k: int) -> list[tuple]:
    """As ``_walk`` over all rows, in whole numbers of any size, held at the ends of a long."""
    tops = [_empty(len(asks["row"]), k) for _ in range(max(windows, 1))]
    x = [[int(v) for v in r] for r in shard["x"]]
    for m, q in enumerate([int(v) for v in r] for r in asks["x"]):
        scores = [max(NONE + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, r, strict=True)))) for r in x]
        for s, (ts, ti, tp) in enumerate(tops):
            ok = (j for j, score in enumerate(scores) if asks["low"][m, s] <= score <= asks["high"][m, s] and (shard["label"][j] != asks["label"][m] if windows else shard["label"][j] == asks["label"][m] and shard["row"][j] != asks["row"][m]))
            for n, j in enumerate(sorted(ok, key=lambda j: (-scores[j], shard["id"][j]))[:k]):
                ts[m, n], ti[m, n], tp[m, n] = scores[j], shard["id"][j], shard["row"][j]
    return tops


def _stacked(df: pd.DataFrame) -> np.ndarray:
    return np.stack(df["v"].to_list()).astype(np.float64)


def search_block(vectors: pd.DataFrame, asks: pd.DataFrame, windows: int, k: int) -> pd.DataFrame:
    """Finds of one shard for one block of anchors: anchor, slot, place (row number), vec_id, score."""
    out = []
    if len(vectors) and len(asks):
        shard = {"x": _stacked(vectors), "id": vectors["vec_id"].to_numpy(), "row": vectors["row"].to_numpy(), "label": vectors["label"].to_numpy()}
        x = _stacked(asks)
        every = {"x": x, "row": asks["row"].to_numpy(), "label": asks["label"].to_numpy(), "low": np.stack(asks["low"].to_list()).astype(np.int64), "high": np.stack(asks["high"].to_list()).astype(np.int64)}
        most = max(np.abs(shard["x"]).max(initial=0), np.abs(x).max(initial=0))
        exact = bool(x.shape[1]) and float(most) * float(most) * x.shape[1] < EXACT
        norms, every["norm"] = np.linalg.norm(shard["x"], axis=1), np.linalg.norm(x, axis=1)
        of = asks["cluster"].to_numpy()
        for cluster in np.unique(of):
            own = np.flatnonzero(of == cluster)
            shared = Shared(shard["x"], norms, x[own], every["norm"][own]) if exact else None
            for part in np.split(own, range(WALKERS, len(own), WALKERS)):
                some = {name: a[part] for name, a in every.items()}
                tops = _walk(shared, shard, some, windows, k)[0] if exact else _plain(shard, some, windows, k)
                for slot, (s, i, p) in enumerate(tops):
                    m, j = np.nonzero(s > NONE)
                    out.append(pd.DataFrame({"anchor": some["row"][m], "slot": np.full(len(m), slot, np.int32), "place": p[m, j], "vec_id": i[m, j], "score": s[m, j]}))
    return pd.concat(out) if out else pd.DataFrame({"anchor": [], "slot": [], "place": [], "vec_id": [], "score": []}).astype("int64").astype({"slot": "int32"})


def _fitted(anchors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centres by dimension, for the dimensions of a sample of the anchors."""
    some = anchors.where("dim > 0").select("dim", "v", F.xxhash64("row").alias("h"), "row").orderBy("h", "row").limit(sample)
    found: dict[int, list] = {}
    for r in some.select("dim", "v").toLocalIterator():
        found.setdefault(r["dim"], []).append(r["v"])
    return {dim: centres(np.array(x, dtype=np.float64), max(1, min(CLUSTERS, len(x) // CLUSTER_ROWS))) for dim, x in found.items()}


def _dealt(anchors: DataFrame, fitted: dict[int, np.ndarray]) -> DataFrame:
    """``anchors`` with the number of the centre that is nearest by angle; 0 for a dimension that has none."""
    names = anchors.columns

    def near(batches):
        for df in batches:
            cluster = np.zeros(len(df), dtype=np.int32)
            for dim in df["dim"].unique():
                if dim in fitted:
                    own = np.flatnonzero((df["dim"] == dim).to_numpy())
                    cluster[own] = (_stacked(df.iloc[own]) @ fitted[dim].T).argmax(axis=1)
            yield df[names].assign(cluster=cluster)

    kinds = ", ".join(f"{n} {t}" for n, t in anchors.dtypes)
    return anchors.mapInPandas(near, f"{kinds}, cluster int")


def _searched(vectors: DataFrame, asks: DataFrame, windows: int, k: int, blocks: int, shards: int, name: str) -> DataFrame:
    """The k best of each window of each ask over all shards: anchor, slot, place, vec_id, score, rank.

    asks: row, label, v, dim, block, cluster, and arrays low and high.
    """
    keys = ["dim", "shard", "block"]
    sent = ["row", "vec_id", "label", "v"]
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")

    def met(each: DataFrame, some: DataFrame) -> DataFrame:
        each = each.select(*keys, *sent)
        some = some.select(*keys, "row", "label", "v", "cluster", "low", "high")
        return each.groupBy(*keys).cogroup(some.groupBy(*keys)).applyInPandas(lambda a, b: search_block(a, b, windows, k), _FOUND)

    every = vectors.withColumn("block", spread)
    first = written(met(every.where(F.col("shard") == home), asks.withColumn("shard", home)), f"{name}-first")
    # What an ask has k of in its first shard sets the least score for the others.
    kth = first.groupBy("anchor", "slot").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "s"))).alias("kth"))
    raised = F.transform("low", lambda x, i: F.coalesce(F.greatest(x, F.col("kth")[i.cast("int")]), x))
    others = asks.join(kth, F.col("row") == F.col("anchor"), "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(raised))
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    rest = met(every.where(F.col("shard") != home), others)
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    label: str = "label", id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    x = vectors.where(F.col(label).isNotNull())
    x = usable(x, id_col, vec_col, F.col(label).cast("long").alias("label"))
    x = written(x, "vectors")  # written once, so row numbers stay
    n = x.count()
    shards, blocks = -(-n // SHARD_ROWS) or 1, -(-n // (every * BLOCK_ROWS)) or 1
    data = x.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    anchors = x.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int"))
    anchors = written(_dealt(anchors, _fitted(anchors)), "anchors")
    least, most = F.lit(NONE + 1), F.lit(np.iinfo(np.int64).max)
    asks = anchors.withColumn("low", F.array(least)).withColumn("high", F.array(most))
    found = written(_searched(data, asks, 0, positives, blocks, shards, "positives"), "positives")
    # Windows in whole numbers, in decimals so that no product overflows.
    score = F.col("score").cast("decimal(20,0)")
    edges = F.sort_array(F.collect_list(F.struct("rank", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))))
    windows = found.where("score >= 0").groupBy("anchor").agg(edges.alias("e"))
    pad = lambda c, fill: F.concat(F.col(f"e.{c}"), F.array_repeat(fill, F.lit(positives) - F.size("e")))
    windows = windows.select("anchor", pad("low", F.lit(0).cast("long")).alias("low"), pad("high", F.lit(-1).cast("long")).alias("high"))
    asks = anchors.join(windows, F.col("row") == F.col("anchor")).drop("anchor")
    near = _searched(data, asks, positives, negatives, blocks, shards, "negatives")
    near = near.select(F.col("anchor").alias("_a"), (F.col("slot") + 1).alias("_slot"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("_row"), F.col("vec_id").alias("anchor_id"))
    out = pairs.join(near, (F.col("anchor") == F.col("_a")) & (F.col("slot") == F.col("_slot"))).join(ids, F.col("anchor") == F.col("_row"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


SQL = """
with v as (select row_number() over () n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
 where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.n an, a.vec_id anchor_id, c.n cn, c.vec_id, a.label = c.label own, list_dot_product(a.v, c.v)::bigint score from v a join v c on a.n <> c.n and len(a.v) = len(c.v) where a.vec_id % 50 = 0),
p as (select *, row_number() over (partition by an order by score desc, vec_id) r from s where own qualify r <= 5),
m as (select p.anchor_id, p.vec_id positive_id, p.r, s.vec_id negative_id, p.score positive_score, s.score negative_score, row_number() over (partition by p.an, p.r order by s.score desc, s.vec_id)::int rank
 from p join s on p.an = s.an and not s.own and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from m where rank <= 3
"""
