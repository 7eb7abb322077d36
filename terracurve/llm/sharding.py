"""Sharding by Karmarkar-Karp differencing over groups of equal texts.

Rows with equal texts form a group that no shard boundary cuts (null counts as
the empty text). Groups are told apart by a 64-bit hash; should two texts share
one, they go to the same shard. A group of more than one HEAVY-th of all bytes
is an item of its own, and there can be at most HEAVY of those; all others are
dealt by hash into at most BUNDLES bundles, each an item. So the driver
differences at most HEAVY + BUNDLES items, whatever the input: every item starts
as a partial partition with its size in one part; the two partial partitions
with the largest spread are combined, the largest part of one with the smallest
of the other, until one is left.

The law is ``bytes``: shard sizes differ by no more than the largest group
makes inevitable; on the sample tables they differ by one byte, as when all groups
are items. Places in a shard are gapless, in an order by hash; ties have either.
Repeated rows take places of their own. Very long texts only count by their size.
Rows without doc_id are placed by their text. Only doc_id and text are read, so
other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICES, running_total, table, written

SHARDS = 8
HEAVY, BUNDLES = 4096, 8192


def difference(sizes: list[int], parts: int) -> list[int]:
    """The part of each item.

    A partial partition is a list of (sum, set) in descending order of sum. A
    set is a tree of the sets it was combined from, so combining is cheap.
    """
    if not sizes:
        return []
    heap = []
    for i, size in enumerate(sizes):
        state = [(size, (i,))] + [(0, ())] * (parts - 1)
        heap.append((-size, i, state))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = [(x + y, (p, q) if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        joined.sort(key=lambda s: -s[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], tie, joined))
        tie += 1
    out = [0] * len(sizes)
    for part, (_, tree) in enumerate(heap[0][2]):
        todo = [tree]
        while todo:
            for x in todo.pop():
                if isinstance(x, tuple):
                    todo.append(x)
                else:
                    out[x] = part
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and the hash that names the group."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    spark = docs.sparkSession
    rows = written(sized(docs), "shard-sizes")
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = groups.where(F.col("bytes") * HEAVY > total).select("group", "bytes")
    bundle = F.pmod(F.xxhash64("group"), F.lit(BUNDLES))
    light = groups.where(F.col("bytes") * HEAVY <= total).groupBy(bundle.alias("item")).agg(F.sum("bytes").alias("bytes"))
    # At most HEAVY rows and at most BUNDLES rows.
    big = [(r["group"], r["bytes"]) for r in heavy.orderBy("group").collect()]
    rest = [(r["item"], r["bytes"]) for r in light.orderBy("item").collect()]
    part = difference([b for _, b in big + rest], shards)
    of_big = spark.createDataFrame([(g, p) for (g, _), p in zip(big, part, strict=False)], "group long, _heavy int")
    of_rest = spark.createDataFrame([(i, p) for (i, _), p in zip(rest, part[len(big):], strict=False)], "_item long, _light int")
    placed = rows.join(F.broadcast(of_big), "group", "left").join(F.broadcast(of_rest), bundle == F.col("_item"), "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("_heavy", "_light").alias("shard"), F.pmod(F.xxhash64(F.lit(SHARDS), "doc_id", "text_crc32", "size"), F.lit(SLICES)).alias("slice"))
    placed = running_total(written(placed, "shard-placed"), ["shard"], "slice", ["doc_id", "text_crc32"], F.lit(1), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
