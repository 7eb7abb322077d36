"""SimHash near-dedup with verified links: five-word shingles of similarity 0.8 or more.

The law of ``simhash`` (three-word shingles, 3 bits) finds close copies only. Here
candidates are texts within ``RADIUS`` bits in one of ``PRINTS`` fingerprints of 64
bits, found by the same covering masks; their features are words, weighted by the
root of their count, which an edit changes less than shingles. At a similarity of
0.8 one word in 45 is changed, so texts without a repeated word differ by 4.3 bits
on average and those with common words by less. Candidates are verified on their
shingles where they meet, so the result has true links only.

Links between fingerprints make candidate components, in which every text lies once,
so its shingles travel once however many masks it shares with others. A task
compares the texts of a component that lie within the radius, and returns a spanning
forest of the true links, never all pairs. Large components are cut into chunks, and
each pair of chunks is one task's work.

Null texts count as empty. Texts without a shingle are like equal words only.
Repeated rows belong to one component. Very long texts are read whole. Ties have no part in it: components don't depend on the order
of rows, and their name is the smallest doc_id. Only doc_id and text are read, so other columns may have any names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import sieve, sieved, written
from .components import components
from .passages import _ODD, _mixed, tokens

PRINTS, RADIUS, CHUNK = 5, 4, 2048


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of the text's shingles, or that of its words if they are too few."""
    x = np.unique(tokens(text))
    return x if len(x) else np.array([xxhash.xxh64_intdigest(b" ".join(text.lower().split()))], dtype=np.uint64)


def prints(text: bytes) -> np.ndarray:
    """The fingerprints of the text's words; a bit is set where the words with it weigh over half."""
    split = text.lower().split()
    words, counts = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split)), return_counts=True)
    weights, out = np.sqrt(counts), np.zeros(PRINTS, dtype=np.uint64)
    for k in range(PRINTS if len(words) else 0):
        total = np.zeros(64)
        for at in range(0, len(words), 65_536):
            h = _mixed(words[at : at + 65_536] ^ (_ODD[0] - np.uint64(k)))
            total += weights[at : at + 65_536] @ np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[k] = np.packbits(2 * total > weights.sum(), bitorder="little").view(np.uint64)[0]
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [prints(t.as_buffer().to_pybytes()).view(np.int64) for t in batch.column("text")]
        if found:
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(found, pa.list_(pa.int64()))], ["t", "fps"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingles(t.as_buffer().to_pybytes()).astype(np.uint32)).view(np.int32) for t in batch.column("text")]
        if sets:
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(sets, pa.list_(pa.int32()))], ["t", "own"])


def forest(names: list[int], sets: list[np.ndarray], fps: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (member, first of its component) of the texts within the radius that have a similarity of 0.8 or more, by breadth-first search."""
    order = {t: i for i, t in reversed(list(enumerate(names)))}
    names, sets, fps = list(order), [np.sort(sets[i]) for i in order.values()], np.stack([fps[i] for i in order.values()])
    sizes = np.array([len(s) for s in sets])
    left, found = np.arange(len(names)), []
    while len(left) > 1:
        root, edge, left = left[0], [left[0]], left[1:]
        while edge and len(left):
            at = edge.pop()
            cand = np.flatnonzero((np.bitwise_count(fps[left] ^ fps[at]) <= RADIUS).any(axis=1))
            if not len(cand):
                continue
            own, others = sets[at], left[cand]
            every, starts = np.concatenate([sets[i] for i in others]), np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            both = np.add.reduceat(hit.astype(np.int64), starts)
            near = 5 * both >= 4 * (sizes[others] + len(own) - both)
            edge += others[near].tolist()
            found += [(names[i], names[root]) for i in others[near]]
            left = np.delete(left, cand[near])
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by component and chunks; one pair of chunks is held at a time."""
    key, held = None, []

    def out() -> pa.RecordBatch:
        x = np.array(forest(*map(list, zip(*held, strict=True))), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["u", "v"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q")), strict=True)
        for own, name, part, fp in zip(keys, batch.column("t").to_pylist(), batch.column("own"), batch.column("fps"), strict=True):
            if own != key and held:
                yield out()
                held = []
            key = own
            held.append((name, part.values.to_numpy(zero_copy_only=False).copy(), fp.values.to_numpy(zero_copy_only=False).view(np.uint64).copy()))
    if held:
        yield out()


def candidates(fps: DataFrame) -> DataFrame:
    """t, key: the candidate components with more than one text. ``fps``: t, fps. A fingerprint that only one text has, and no link, makes no node."""
    nodes = fps.select("t", F.posexplode("fps").alias("space", "fp"))
    prints = written(nodes.groupBy("space", "fp").agg(F.count(F.lit(1)).alias("n")), "prints")
    each = simhash.links(prints.select("space", "fp"), radius=RADIUS)
    each = written(each.select(*(F.xxhash64("space", c).alias(c) for c in ("u", "v"))), "print-links")
    nodes = nodes.select("t", F.xxhash64("space", "fp").alias("node"))
    shared = prints.where("n > 1").select(F.xxhash64("space", "fp").alias("_node"))
    shared = written(shared.union(each.select("u")).union(each.select("v")).distinct(), "print-nodes")
    found = components(nodes.join(shared, F.col("node") == F.col("_node")).select(F.col("t").alias("u"), F.col("node").alias("v")).union(each))
    return fps.select("t").join(found, F.col("t") == F.col("node")).select("t", F.col("root").alias("key"))


def links(docs: DataFrame, ids: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """u, v: a forest of links between texts, by hash. ``docs``: doc_id, t, text (binary); ``ids``: t, least (doc_id)."""
    fps = written(docs.select("t", "text").mapInArrow(_prints, "t long, fps array<long>").groupBy("t").agg(F.first("fps").alias("fps")), "fingerprints")
    met = written(candidates(fps), "candidates")
    many = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = written(many.select(F.col("key").alias("_k"), F.expr(f"(n + {chunk - 1}) div {chunk}").cast("int").alias("chunks")), "large")
    met = written(met.join(many, F.col("key") == F.col("_k")).select("key", "t", "chunks"), "members")
    wanted = written(met.select("t").join(ids, "t").select(F.col("t").alias("_t"), "least"), "wanted")
    docs = sieved(docs, sieve(wanted, F.col("least"), wanted=F.lit(True)), F.col("doc_id"), "wanted").where("wanted")
    sets = docs.join(wanted, (F.col("doc_id") == F.col("least")) & (F.col("t") == F.col("_t"))).select("t", "text")
    sets = sets.dropDuplicates(["t"]).mapInArrow(_sets, "t long, own array<int>").join(fps, "t")
    own = F.pmod(F.xxhash64("t"), F.col("chunks")).cast("int")
    met = met.withColumn("one", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("key", F.least("one", "other").alias("p"), F.greatest("one", "other").alias("q"), "t").join(written(sets, "sets"), "t")
    return met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_links, "u long, v long")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (one for each component), component_id (its smallest doc_id) of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"))
    ids = written(own.groupBy("text_hash").agg(F.min("doc_id").alias("least"), F.min(F.coalesce("doc_id", F.lit(-1))).alias("any")), "ids")
    nodes = written(components(links(rows, ids.select(F.col("text_hash").alias("t"), F.col("any").alias("least")))), "nodes")
    each = ids.join(nodes, F.col("text_hash") == F.col("node"), "left").select(F.col("text_hash").alias("_h"), "least", F.coalesce("root", "text_hash").alias("fp"))
    each = written(each, "each")
    least = each.groupBy("fp").agg(F.min("least").alias("component_id"))
    of = written(each.select("_h", "fp").join(least, "fp"), "components")
    return own.join(of, F.col("text_hash") == F.col("_h")).select("doc_id", "text_hash", "fp", "component_id")
