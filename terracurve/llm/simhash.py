"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is set if it is set in over half the hashes of
the text's shingles. Fingerprints that differ in at most ``RADIUS`` bits link.
Covering masks: every bit gets a vector of RADIUS + 1 bits, not zero, and mask m
(also not zero) keeps the bits whose vector has an odd inner product with m.
For up to RADIUS differing bits some m is orthogonal to all their vectors, so
under that mask the two fingerprints agree: no pair is missed. 15 masks of
about 34 bits serve radius 3.

Distinct fingerprints only are dealt to the masks' buckets. Buckets with one
are dropped; those with more than ``CHUNK`` are cut by hash into chunks and each
pair of chunks is one task's work, so hot buckets split exactly. A task returns
a spanning forest of the true links it sees, never all pairs. Components of the
forest then give every document the smallest doc_id reachable.

Null texts count as empty; their fingerprint is zero, linked like any other.
Rows without doc_id get a fingerprint and the component of their links, null if
that has no doc_id. Repeated rows come back as often as they occur, and ties of the
smallest doc_id are one and the same. Very long texts are read whole, in slices of
shingles. Columns of the documents may have any names. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, table, written
from .components import components

RADIUS, SHINGLE, CHUNK = 3, 3, 4096


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    size = 2 ** (radius + 1)
    vector = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & m).bit_count() % 2) for m in range(1, size)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, n) - 1
    firsts, lasts = starts[: n - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    total, m = np.zeros(64, dtype=np.int64), len(firsts)
    for at in range(0, m, 65_536):
        part = slice(at, at + 65_536)
        h = np.fromiter((digest(view[a:b], 42) for a, b in zip(firsts[part], lasts[part], strict=True)), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > m, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (member, first of its component) among distinct unsigned prints, by breadth-first search in slices."""
    left, found = np.sort(prints), []
    while len(left) > 1:
        root, edge, left = left[0], left[:1], left[1:]
        while len(edge) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(edge), 256):
                near |= (np.bitwise_count(edge[at : at + 256, None] ^ left[None, :]) <= radius).any(axis=0)
            edge, left = left[near], left[~near]
            found += [(int(x), int(root)) for x in edge]
    return found


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by bucket; a bucket is held at a time."""

    def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        x = np.array(found, dtype=np.uint64).reshape(-1, 3).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(x[:, 1]), pa.array(x[:, 2])], ["mask", "u", "v"])

    def close(mask: int, parts: list[np.ndarray]) -> list[tuple[int, int, int]]:
        p = np.concatenate(parts)
        if len(p) == 2:
            a, b = int(p[0]), int(p[1])
            return [(mask, max(a, b), min(a, b))] if (a ^ b).bit_count() <= radius else []
        return [(mask, a, b) for a, b in forest(p, radius)]

    key, parts, found = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "kept", "p", "q")])
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            own = tuple(keys[:, a].tolist())
            if own != key and parts:
                found += close(key[0], parts)
                parts = []
                if len(found) >= 50_000:
                    yield out(found)
                    found = []
            key = own
            parts.append(fp[a:b].copy())
    if parts:
        found += close(key[0], parts)
    if found:
        yield out(found)


def links(prints: DataFrame, chunk: int = CHUNK, radius: int = RADIUS) -> DataFrame:
    """space, u, v: a forest of links between the distinct fingerprints of ``prints`` (fp, and space if there are several); those of different spaces (small ints) never link."""
    every = covering_masks(radius)
    prints = prints if "space" in prints.columns else prints.withColumn("space", F.lit(0))
    masks = F.array(*(F.struct(F.lit(i).alias("mask"), F.lit(m - 2**64 if m >= 2**63 else m).cast("long").alias("bits")) for i, m in enumerate(every)))
    dealt = prints.select("fp", "space", F.explode(masks).alias("m"))
    dealt = dealt.select("fp", (F.col("space") * len(every) + F.col("m.mask")).alias("mask"), F.col("fp").bitwiseAND(F.col("m.bits")).alias("kept"))
    many = dealt.groupBy("mask", "kept").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = written(many.select(F.col("mask").alias("_m"), F.col("kept").alias("_k"), F.expr(f"(n + {chunk - 1}) div {chunk}").cast("int").alias("chunks")), "buckets")
    met = dealt.join(many, (F.col("mask") == F.col("_m")) & (F.col("kept") == F.col("_k")))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = met.withColumn("own", own).withColumn("other", other)
    met = met.select("mask", "kept", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    found = met.repartition("mask", "kept", "p", "q").sortWithinPartitions("mask", "kept", "p", "q").mapInArrow(lambda batches: _links(batches, radius), "mask int, u long, v long")
    return found.select(F.expr(f"mask div {len(every)}").cast("int").alias("space"), "u", "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, component_id of every document."""
    rows = written(fingerprints(docs), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    nodes = written(components(links(prints.select("fp"))), "nodes")
    least = nodes.join(prints, nodes["node"] == prints["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = nodes.join(least, "root").select("node", "component_id")
    of = written(prints.join(linked, prints["fp"] == linked["node"], "left").select(F.col("fp").alias("_fp"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "components")
    return rows.join(of, rows["fp"] == of["_fp"]).select("doc_id", "text_hash", "fp", "component_id")


def first_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The documents with one of each component left: the smallest doc_id, else the smallest text hash.

    ``found``: the components, if they aren't those of ``near_duplicates``.

    Kept keys meet the texts in one shuffle by doc_id, which no key makes uneven.
    """
    found = near_duplicates(docs) if found is None else found
    lone = F.col("component_id").isNull()  # only rows without doc_id: told apart by fingerprint
    best = found.groupBy("component_id", F.when(lone, F.col("fp")).alias("_f")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("k"))
    best = best.select(F.coalesce("k.doc_id", F.lit(-1)).alias("_d"), F.col("k.n").alias("_n"), F.col("k.text_hash").alias("_t"))
    own = boxed(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_d0"), F.col("doc_id").isNull().alias("_n0"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t0"))
    met = own.join(written(best, "kept"), (F.col("_d0") == F.col("_d")) & (F.col("_n0") == F.col("_n")) & (F.col("_t0") == F.col("_t")))
    one = Window.partitionBy("_d0", "_n0", "_t0").orderBy(F.lit(1))
    return met.withColumn("_one", F.row_number().over(one)).where("_one = 1").select("_row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
