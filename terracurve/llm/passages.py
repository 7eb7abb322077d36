"""Near-duplicate passages by compact windows.

A text's tokens are hashes of five-word shingles, and its anchors hashes of
ten-word shingles. For each of ``HASHES`` min-hash functions the Cartesian tree
over the anchors' hash values gives compact windows: every span in one has the
same minimum. The windows of all functions are joined by their intervals, so a
joint window is a run of spans of ``RUN`` words that have the same minima under
all functions; its key is made of the minima and their distances. Passages of
``WORDS`` words or more and a similarity of ``LEAST`` hold a common run of ``RUN``
words, wherever their edits stand (with one edit in every 50 words at most, the
longest run has 25), and two texts with a common run have a joint window there
with one key. So no hash need be lucky, and a frequent line that is shorter than
a run seldom makes a key.

All texts that share a key are compared. Under a key of few windows pairs of windows are rows; those of
a pair of texts that follow one another are joined to regions, which are verified on their tokens: the longest
spans whose tokens occur in the other region with a density of ``DENSE``, trimmed to tokens in
common, are a passage if both hold ``WORDS`` words and their Jaccard similarity is
at least ``LEAST``; where they aren't, all spans of ``TOKENS`` tokens are compared. Texts with a key of over ``LARGE`` windows are
dealt into blocks, and a task takes two blocks that have such a key in common. There texts that hold the same
of what others hold too are one class; pairs of classes are verified, and links are counted for each text, so pairs of texts are never
rows. A pair with a large key is compared there only, any other one by its regions only.

The blocks' pairs, and the pairs of classes of texts that differ in what they share (edited copies of one text), grow with the
square of a group. Where a text repeats a passage, each of its places is compared until it is linked.

Equal texts are compared once, and copies get the passages of their text. Classes
of passages are components of the verified links and of equal texts of ``WORDS``
words or more. Overlapping passages of a text are one row.

Null texts count as empty and rows without doc_id take no part. Repeated rows
are one document. Texts shorter than ``WORDS`` words have no passages. Very long
texts are cut into windows whole, in linear time even where words repeat. Of equal
minima the leftmost counts. Only doc_id and text are read, so other columns may
have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sieve, sieved, small_enough, table, words, written
from .components import components

SHINGLE, WORDS, LEAST = 5, 50, 0.8
#: Tokens of a passage, and the places on both sides of a joint window within which one lies that is found through it.
TOKENS = WORDS - SHINGLE + 1
MARGIN = 2 * TOKENS
#: Hash functions, words of an anchor, and anchors that every joint window spans: RUN words in all.
HASHES, ANCHOR, RUN = 2, 10, 25
SPAN = RUN - ANCHOR + 1
#: A span has density p / q if hits * q >= p * length. A similarity of 0.8 needs 8 / 9; a long span that
#: has no more than that may yet fail, so denser ones in it are tried, down to unbroken runs.
DENSE = [(8, 9), (19, 20), (1, 1)]
#: Tokens in common of two spans of TOKENS that have that similarity, and spans of a text that are compared with others at once.
COMMON, STRIP = math.ceil(2 * TOKENS * LEAST / (1 + LEAST)), 128
#: Words by which offsets in a region may differ from one window to the next, and places from one window to the next.
DRIFT, GAP = 16, 2 * MARGIN
#: Bounds of regions are rounded to this, so that a text's regions with many others are the same few.
ROUND = 64
#: A key of more windows is large: its pairs of texts aren't made as rows but counted by pairs of blocks of about MEMBERS texts.
LARGE, MEMBERS = 8, 512
#: Runs in common of two texts without repeated tokens up to which passages are looked for run by run.
RUNS = 64
#: Hulls of runs, of all pairs that are looked at together.
TABLE = 1 << 15
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of a splitmix generator)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashes(split: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))


def _tokens(w: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of words with these hashes."""
    n, w = len(w) - SHINGLE + 1, _mixed(w)
    return _mixed(sum((w[j : j + n] * _ODD[j] for j in range(1, SHINGLE)), w[:n] * _ODD[0]))


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the five-word shingles; A-Z count as lower case."""
    split = text.lower().split()
    return _tokens(_hashes(split)) if len(split) >= SHINGLE else np.empty(0, dtype=np.uint64)


def anchors(x: np.ndarray) -> np.ndarray:
    """Hashes of the ``ANCHOR``-word shingles, from the tokens at their start and end."""
    return _mixed(_mixed(x[: len(x) - ANCHOR + SHINGLE]) * _ODD[1] + x[ANCHOR - SHINGLE :])


def minima(values: np.ndarray, least: int) -> np.ndarray:
    """Of every span of ``least`` places, in order: the place of its minimum, the leftmost of equal ones.

    The places are the nodes of the values' Cartesian tree that span at least ``least`` places, and the spans of one place are its
    compact window; minima of spans of doubling length find them without recursion, whatever the values are.
    """
    if len(values) < least:
        return np.empty(0, dtype=np.int64)
    at, span = np.arange(len(values)), 1
    while span < least:
        step = min(span, least - span)
        left, right = at[: len(at) - step], at[step:]
        at, span = np.where(values[right] < values[left], right, left), span + step
    return at


def signatures(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's tokens: the keys and places of its joint windows."""
    return joint_windows(x, np.array([0]), np.array([len(x) + SHINGLE - 1]))[1:]


def joint_windows(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' tokens, one text after the other: the text, key and place of each joint window. ``begin`` and ``end``: the texts' words.

    The compact windows of ``HASHES`` functions over the anchors are joined by their intervals: spans of ``SPAN`` anchors with the
    same minima under all functions are one joint window. Its key is made of the minima and of the distances between them.
    Spans that go beyond a text don't count.
    """
    n = np.maximum(end - begin - RUN + 1, 0)
    if not n.sum():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    y = anchors(x)
    text = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(text)) + np.repeat(begin - (np.cumsum(n) - n), n)
    at = np.stack([minima(_mixed(y ^ _ODD[k]), SPAN)[within] for k in range(HASHES)])
    new = np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(axis=0)])
    at, text = at[:, new], text[new]
    key = np.zeros(at.shape[1], dtype=np.uint64)
    for row in at:
        key = _mixed(key ^ y[row]) + (row - at[0]).astype(np.uint64)
    # Where a text repeats itself, one window of a key in every stretch of MARGIN places tells as much as all.
    place = at[0] - begin[text]
    order = np.lexsort((place, key, text))
    text, key, place = text[order], key[order], place[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (place[1:] // MARGIN != place[:-1] // MARGIN)])
    return text[new], key[new], place[new]


#: Words of the texts whose windows are found together.
TOGETHER = 1 << 17


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(names, words):
        end = np.cumsum([len(w) for w in words])
        text, key, c = joint_windows(_tokens(np.concatenate(words)), end - [len(w) for w in words], end)
        return np.array(names, dtype=np.int64)[text], key, c

    for batch in batches:
        out, names, words, held = [], [], [], 0
        for name, body in zip(batch.column("text_hash").to_pylist(), batch.column("text"), strict=True):
            split = body.as_buffer().to_pybytes().lower().split()
            if len(split) >= WORDS:
                names.append(name)
                words.append(_hashes(split))
                held += len(split)
                if held >= TOGETHER:
                    out.append(found(names, words))
                    names, words, held = [], [], 0
        if names:
            out.append(found(names, words))
        if out:
            text, key, c = (np.concatenate(z) for z in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(text), pa.array(c.astype(np.int32))], ["key", "text", "c"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads windows sorted by (key, text, c): gives those of keys that two texts or more have, each once; large: the key has over ``LARGE`` windows."""
    held, before = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)], None
    for batch in itertools.chain(batches, [None]):
        rows = held if batch is None else [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        new = np.ones(len(rows[0]), dtype=bool)
        new[1:] = np.any([z[1:] != z[:-1] for z in rows], axis=0)
        if before is not None and len(new):
            new[0] = any(z[0] != y for z, y in zip(rows, before, strict=True))
        rows = [z[new] for z in rows]
        key, text, _ = rows
        if not len(key):
            held = rows
            continue
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(start, len(key)))
        on = before is not None and key[0] == before[0]  # the first key is a large one that was given in part
        large, give = count > LARGE, text[start] != text[start + count - 1]
        large[0] |= on
        give[0] |= on
        if batch is not None:  # the last key may go on
            give[-1] &= large[-1]
        keep = start[-1] if batch is not None and not give[-1] else len(key)
        before = [z[-1] for z in rows] if give[-1] else None
        chosen = np.repeat(give, count)
        if chosen.any():
            yield pa.RecordBatch.from_arrays([*(pa.array(z[chosen]) for z in rows), pa.array(np.repeat(large, count)[chosen])], ["key", "t", "c", "large"])
        held = [z[keep:] for z in rows]


def shared_windows(rows: DataFrame) -> DataFrame:
    """key, t, c, large: the windows whose key two texts or more have. ``rows``: text_hash, text (binary)."""
    windows = rows.mapInArrow(_windows, "key long, text long, c int")
    return windows.repartition("key").sortWithinPartitions("key", "text", "c").mapInArrow(_shared, "key long, t long, c int, large boolean")


def window_links(shared: DataFrame) -> DataFrame:
    """t1, c1, t2, c2: all pairs of windows of two texts under each key that isn't large, at most ``LARGE`` / 2 for each window."""
    small = shared.where("not large")
    one, two = small.select("key", F.col("t").alias("t1"), F.col("c").alias("c1")), small.select(F.col("key").alias("_key"), F.col("t").alias("t2"), F.col("c").alias("c2"))
    return one.join(two, (F.col("key") == F.col("_key")) & (F.col("t1") > F.col("t2"))).select("t1", "c1", "t2", "c2")


def regions(links: DataFrame) -> DataFrame:
    """t1, l1, r1, t2, l2, r2: hulls of the windows of a pair of texts that follow one another, with a margin."""
    df = links.select("t1", "c1", "t2", "c2", (F.col("c1") - F.col("c2")).alias("d"))
    order = Window.partitionBy("t1", "t2").orderBy("d", "c1", "c2")
    new = (F.col("d") - F.lag("d").over(order) > DRIFT) | (F.abs(F.col("c1") - F.lag("c1").over(order)) > GAP)
    df = df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    df = df.withColumn("_at", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low = lambda c: F.expr(f"greatest(min({c}) - {MARGIN}, 0) div {ROUND} * {ROUND}").cast("int")
    high = lambda c: F.expr(f"(max({c}) + {MARGIN}) div {ROUND} * {ROUND} + {ROUND - 1}").cast("int")
    return df.groupBy("t1", "t2", "_at").agg(low("c1").alias("l1"), high("c1").alias("r1"), low("c2").alias("l2"), high("c2").alias("r2")).drop("_at")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens, cut to 32 bits, of each region of each text."""
    schema = pa.schema([("text_hash", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("part", pa.list_(pa.int32()))])
    for batch in batches:
        names, ls, rs, parts, held = [], [], [], [], 0
        for name, body, spans in zip(batch.column("text_hash").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            x = tokens(body.as_buffer().to_pybytes()).astype(np.uint32).view(np.int32)
            for s in spans:
                names.append(name)
                ls.append(s["l"])
                rs.append(s["r"])
                parts.append(x[s["l"] : s["r"] + 1])
                held += len(parts[-1])
                if held >= 2_000_000:
                    yield _parts(schema, names, ls, rs, parts)
                    names, ls, rs, parts, held = [], [], [], [], 0
        if names:
            yield _parts(schema, names, ls, rs, parts)


def _parts(schema, names, ls, rs, parts) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ls, pa.int32()), pa.array(rs, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))], schema=schema)


def _is_dense(hits, length):
    return hits * DENSE[0][1] >= length * DENSE[0][0]


def _dense(hit: np.ndarray, part: tuple[int, int]) -> tuple[int, int] | None:
    """The longest span (first, end) of that density, if it has ``TOKENS`` places."""
    if np.count_nonzero(hit) * part[1] < TOKENS * part[0]:
        return None
    total = np.zeros(len(hit) + 1, dtype=np.int32)
    np.where(hit, np.int32(part[1] - part[0]), np.int32(-part[0])).cumsum(out=total[1:])
    start = (-np.minimum.accumulate(total)).searchsorted(-total)  # of each end: the first place with no greater total
    end = int((np.arange(len(total)) - start).argmax())
    return (int(start[end]), end) if end - start[end] >= TOKENS else None


def _trimmed(hit: np.ndarray, span: tuple[int, int]) -> tuple[int, int]:
    """The span without what doesn't hit at both ends."""
    inside = hit[span[0] : span[1]].nonzero()[0]
    return span[0] + int(inside[0]), span[0] + int(inside[-1]) + 1


class _Marks:
    """Sets of numbers below ``n``, in arrays that are made once for many pairs of texts."""

    def __init__(self, n: int):
        self.on, self.last = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int32)

    def hits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each number in ``x``: whether ``y`` has it."""
        self.on[y] = True
        out = self.on[x]
        self.on[y] = False
        return out

    def distinct(self, x: np.ndarray) -> np.ndarray:
        at = np.arange(len(x), dtype=np.int32)
        self.last[x] = at
        return x[self.last[x] == at]

    def similarity(self, x: np.ndarray, y: np.ndarray) -> float:
        one, two = self.distinct(x), self.distinct(y)
        both = int(np.count_nonzero(self.hits(one, two)))
        return both / (len(one) + len(two) - both)


def _full(hit: np.ndarray) -> np.ndarray:
    """The places from which on ``TOKENS`` places have the ``COMMON`` hits that two such spans of a similarity of ``LEAST`` share."""
    total = np.zeros(len(hit) + 1, dtype=np.int32)
    hit.cumsum(out=total[1:])
    return (total[TOKENS:] - total[:-TOKENS] >= COMMON).nonzero()[0]


def _repeats(x: np.ndarray) -> np.ndarray | None:
    """Of each place, the last one before it with the same number, or -1; None if no number is repeated."""
    order = x.argsort(kind="stable")
    again = x[order[1:]] == x[order[:-1]]
    if not again.any():
        return None
    before = np.full(len(x), -1, dtype=np.int32)
    before[order[1:][again]] = order[:-1][again]
    return before


def _alike(hit: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """The places from which on ``TOKENS`` places hit as a set so much that another set can have a similarity of ``LEAST``."""
    at = _full(hit)
    if before is None or not len(at):
        return at
    # A place is new in the spans that begin after the last one before it with its number.
    place = np.arange(len(hit))
    first, n = np.maximum(before + 1, place - TOKENS + 1), len(hit) + 1
    size = np.cumsum(np.bincount(first, minlength=n) - np.bincount(place + 1, minlength=n))
    inside = np.cumsum(np.bincount(first[hit], minlength=n) - np.bincount(place[hit] + 1, minlength=n))
    return at[inside[at] >= LEAST * size[at] - 1e-9]


def _sets(x: np.ndarray, hit: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different sets that spans of ``TOKENS`` places are and of which so much hits that another can have a similarity of ``LEAST``:
    a span of each, its members (places after its first that hit and are new in it) and its size; and of each span its set, or -1."""
    at = _alike(hit, before)
    span = at[:, None] + np.arange(TOKENS)
    new = np.ones(span.shape, dtype=bool) if before is None else before[span] < at[:, None]
    size, inside = new.sum(axis=1), new & hit[span]
    name = np.where(new, _mixed(x.astype(np.uint64))[span], np.uint64(0)).sum(axis=1)
    _, first, again = np.unique(name, return_index=True, return_inverse=True)
    of = np.full(max(len(x) - TOKENS + 1, 0), -1)
    of[at] = again
    return at[first], inside[first], size[first], of


def _sets_in(x: np.ndarray, y: np.ndarray, in_y: np.ndarray, in_x: np.ndarray, before: tuple) -> tuple[int, int, int, int, float] | None:
    """``_spans_in`` where tokens are repeated: spans with the same tokens are compared once, by the number of those in common."""
    one, two = _sets(x, in_y, before[0]), _sets(y, in_x, before[1])
    if not len(one[0]) or not len(two[0]):
        return None
    names, both = np.unique(np.concatenate([x[in_y], y[in_x]]), return_inverse=True)
    ids = [np.zeros(len(z), dtype=np.int64) for z in (x, y)]
    ids[0][in_y], ids[1][in_x] = both[: np.count_nonzero(in_y)], both[np.count_nonzero(in_y) :]

    def table(side, at, inside):
        out = np.zeros((len(at), len(names)), dtype=np.float32)
        row, place = inside.nonzero()
        out[row, ids[side][at[row] + place]] = 1
        return out

    step = max((4 << 20) // len(names), 1)
    most, there = np.zeros(len(one[0])), np.zeros(len(one[0]), dtype=np.int64)
    for j in range(0, len(two[0]), step):
        held = table(1, two[0][j : j + step], two[1][j : j + step]).T
        for i in range(0, len(one[0]), step):
            common = table(0, one[0][i : i + step], one[1][i : i + step]) @ held
            s = common / (one[2][i : i + step, None] + two[2][None, j : j + step] - common)
            best = s.argmax(axis=1)
            s = s[np.arange(len(s)), best]
            more = s > most[i : i + step]
            most[i : i + step][more], there[i : i + step][more] = s[more], two[0][j + best[more]]
    at = np.flatnonzero((one[3] >= 0) & (np.append(most, 0.0)[one[3]] >= LEAST - 1e-9))
    if not len(at):
        return None
    gap = np.flatnonzero(np.diff(at) > TOKENS - 1)
    at = at[: gap[0] + 1] if len(gap) else at
    v = there[one[3][at]]
    return int(at[0]), int(at[-1]) + TOKENS, int(v.min()), int(v.max()) + TOKENS, float(most[one[3][at]].max())


def _spans_in(x: np.ndarray, y: np.ndarray, marks: _Marks) -> tuple[int, int, int, int, float] | None:
    """The first of the spans of ``TOKENS`` tokens, each against each, that are similar enough, and those of x that follow it without a gap."""
    in_y, in_x = marks.hits(x, y), marks.hits(y, x)
    todo = _full(in_y)
    if not len(todo) or not len(_full(in_x)):
        return None
    before = _repeats(x), _repeats(y)
    if before[0] is not None or before[1] is not None:
        return _sets_in(x, y, in_y, in_x, before) if len(_alike(in_y, before[0])) and len(_alike(in_x, before[1])) else None
    while len(todo):
        some, todo = todo[todo < todo[0] + STRIP], todo[todo >= todo[0] + STRIP]
        part = x[some[0] : some[-1] + TOKENS]
        others = _full(marks.hits(y, part))
        while len(others):
            near, others = others[others < others[0] + STRIP], others[others >= others[0] + STRIP]
            same = np.zeros((len(part) + 1, near[-1] - near[0] + TOKENS + 1), dtype=np.int32)
            same[1:, 1:] = part[:, None] == y[None, near[0] : near[-1] + TOKENS]
            same = same.cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)
            both = same[TOKENS:, TOKENS:] - same[:-TOKENS, TOKENS:] - same[TOKENS:, :-TOKENS] + same[:-TOKENS, :-TOKENS]
            found = None
            for r in np.flatnonzero((both >= COMMON).any(axis=1)).tolist():
                v, p = int(near[0]) + int(both[r].argmax()), int(some[0]) + r
                s = marks.similarity(x[p : p + TOKENS], y[v : v + TOKENS])
                if s < LEAST:
                    continue
                if found and p > found[1] - TOKENS + 1:
                    break
                found = (found[0], p + TOKENS, min(found[2], v), max(found[3], v + TOKENS), max(found[4], s)) if found else (p, p + TOKENS, v, v + TOKENS, s)
            if found:
                return found
    return None


def passages_in(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(first, end) in x and in y, in tokens, and similarity of the passages in common; longest first, then on either side of it."""
    ids, both = np.unique(np.concatenate([x, y]), return_inverse=True)
    return _passages(both[: len(x)], both[len(x) :], _Marks(len(ids)))


def _passages(x: np.ndarray, y: np.ndarray, marks: _Marks) -> list[tuple[int, int, int, int, float]]:
    """``passages_in`` of numbers below that of ``marks``.

    A span counts if it is long enough and similar enough, with or without the tokens at its ends that aren't in common; it is
    given without them. So a run of 45 words counts that spans of 50 words around it share to 0.8. Where the longest spans aren't
    similar enough, all spans of ``TOKENS`` tokens are tried.
    """
    out, todo, in_y = [], [(0, len(x), True)], marks.hits(x, y)
    while todo:
        a, b, new = todo.pop()
        if b - a < TOKENS:
            continue
        at = in_y[a:b].nonzero()[0]
        if len(at) * DENSE[0][1] < TOKENS * DENSE[0][0]:
            continue
        p = q = found = None
        p, q = a + int(at[0]), a + int(at[-1]) + 1
        if q - p >= TOKENS and _is_dense(len(at), q - p):
            # All that hits is dense; if it is so in y as well, it is one passage.
            there = marks.hits(y, x[p:q]).nonzero()[0]
            u, v = int(there[0]), int(there[-1]) + 1
            s = marks.similarity(x[p:q], y[u:v]) if v - u >= TOKENS and _is_dense(len(there), v - u) else 0.0
            if s >= LEAST:
                out.append((p, q, u, v, s))
                continue
        p = q = None
        for part in DENSE:
            own = _dense(in_y[a:b], part)
            if own is None:
                break
            own = (a + own[0], a + own[1])
            p, q = _trimmed(in_y, own)
            hit = marks.hits(y, x[p:q])
            other = _dense(hit, part)
            if other is None:
                continue
            u, v = _trimmed(hit, other)
            s = marks.similarity(x[p:q], y[u:v]) if min(q - p, v - u) >= TOKENS else 0.0
            s = s if s >= LEAST else marks.similarity(x[own[0] : own[1]], y[other[0] : other[1]])
            if s >= LEAST:
                found = p, q, u, v, s
                break
        if p is not None and not found and new:
            found = _spans_in(x[a:b], y, marks)
            if found:
                p, q = a + found[0], a + found[1]
                found = p, q, *found[2:]
            new = found is not None
        if found:
            out.append(found)
        if p is not None:
            todo += [(a, p, new), (q, b, new)]
    return out


_FOUND = "t1 long, s1 int, e1 int, t2 long, s2 int, e2 int, similarity double"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["t1", "s1", "e1", "t2", "s2", "e2", "similarity"]
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("t1", "l1", "t2", "l2")]
        x, y = batch.column("x"), batch.column("y")
        for i, (t1, l1, t2, l2) in enumerate(zip(*cols, strict=True)):
            more = SHINGLE - 1
            for p, q, u, v, s in passages_in(x[i].values.to_numpy(zero_copy_only=False), y[i].values.to_numpy(zero_copy_only=False)):
                out.append((t1, l1 + p, l1 + q + more, t2, l2 + u, l2 + v + more, s))
        if out:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _with_texts(wanted: DataFrame, docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """text_hash, text and the column ``name`` of ``wanted`` (t: a text's hash), each text once."""
    wanted = written(wanted.join(ids, F.col("t") == F.col("text_hash")).select("least", "t", name), "wanted")
    docs = sieved(docs, sieve(wanted, F.col("least"), wanted=F.lit(True)), F.col("doc_id"), "wanted").where("wanted")  # keeps most texts out of the shuffle
    return docs.join(wanted, (F.col("doc_id") == F.col("least")) & (F.col("text_hash") == F.col("t"))).select("text_hash", "text", name)


def verified(pairs: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """t1, s1, e1, t2, s2, e2, similarity: the passages in common of ``pairs`` of regions. ``docs``: doc_id, text_hash, text (binary); ``ids``: text_hash, least (doc_id)."""
    spans = pairs.select(F.col("t1").alias("t"), F.col("l1").alias("l"), F.col("r1").alias("r")).union(pairs.select("t2", "l2", "r2")).distinct()
    wanted = spans.groupBy("t").agg(F.collect_list(F.struct("l", "r")).alias("spans"))
    met = _with_texts(wanted, docs, ids, "spans")
    parts = written(met.mapInArrow(_contents, "text_hash long, l int, r int, part array<int>"), "parts")
    one = parts.toDF("_t1", "_l1", "_r1", "x")
    two = parts.select(*(F.col(c).alias(n) for c, n in zip(parts.columns, ("_t2", "_l2", "_r2", "y"), strict=True)))
    both = pairs.join(one, (F.col("t1") == F.col("_t1")) & (F.col("l1") == F.col("_l1")) & (F.col("r1") == F.col("_r1")))
    both = both.join(two, (F.col("t2") == F.col("_t2")) & (F.col("l2") == F.col("_l2")) & (F.col("r2") == F.col("_r2")))
    return both.select("t1", "l1", "x", "t2", "l2", "y").mapInArrow(_verified, _FOUND)


def members(shared: DataFrame) -> DataFrame:
    """t, block, windows, keys (the large ones): the texts that have a large key, dealt into blocks of about ``MEMBERS``.

    Texts lie with those that have the same most frequent key; where these are few, with others whose keys meet the same still more
    frequent one. So a pair of texts that meets mostly lies in one block, and a block meets few others.
    """
    each = written(shared.where("large").select("t", "key").distinct(), "large-keys")
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    first = each.join(often, "key").groupBy("t").agg(F.max(F.struct("n", "key")).alias("own"), F.array_sort(F.collect_set("key")).alias("keys"))
    first = written(first, "first-keys")
    hubs = written(each.join(first.select("t", "own"), "t").groupBy("key").agg(F.max("own").alias("hub")), "hubs")
    hub = each.join(hubs, "key").groupBy(F.col("t").alias("_t")).agg(F.max("hub").alias("hub"))
    met = written(first.join(hub, F.col("t") == F.col("_t")).select("t", "keys", F.col("own.key").alias("_own"), F.col("hub.key").alias("_hub")), "dealt")
    n = met.groupBy(F.col("_own").alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    met = written(met.join(n, F.col("_own") == F.col("_o")).drop("_o"), "sized")
    few = met.where(F.col("_n") < MEMBERS).groupBy(F.col("_hub").alias("_h")).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("_bins"))
    own = F.xxhash64(F.lit(0), "_own", F.pmod(F.xxhash64("t"), F.ceil(F.col("_n") / MEMBERS)))
    block = F.when(F.col("_n") < MEMBERS, F.xxhash64(F.lit(1), "_hub", F.pmod(F.xxhash64("_own"), "_bins"))).otherwise(own)
    met = met.join(few, F.col("_hub") == F.col("_h"), "left").select(F.col("t").alias("_t"), block.alias("block"), "keys")
    windows = shared.join(met.select("_t"), F.col("t") == F.col("_t")).groupBy("t").agg(F.collect_list(F.struct("key", "c", "large")).alias("windows"))
    return windows.join(met, F.col("t") == F.col("_t")).select("t", "block", "windows", "keys")


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens, cut to 32 bits, of each text from its first window to its last, with a margin; l: the first one's place."""
    schema = pa.schema([("_t", pa.int64()), ("l", pa.int32()), ("x", pa.list_(pa.int32()))])
    for batch in batches:
        out, held = [], 0
        for name, body, windows in zip(batch.column("text_hash").to_pylist(), batch.column("text"), batch.column("windows"), strict=True):
            c = windows.values.field("c").to_numpy(zero_copy_only=False)
            low = max(int(c.min()) - MARGIN, 0)
            x = tokens(body.as_buffer().to_pybytes()).astype(np.uint32).view(np.int32)[low : int(c.max()) + MARGIN + 1]
            out.append((name, low, x))
            held += len(x)
            if held >= 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(z, f.type) for z, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(z, f.type) for z, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


class _Class:
    """Texts of a job that hold the same of what others there hold too, at the same distances: numbers of tokens, places by key."""

    def __init__(self, x: np.ndarray, places: dict[int, list[int]]):
        self.x, self.places, self.texts = x, places, ([], [])
        self.ids, self.first, self.times = np.unique(x, return_index=True, return_counts=True)
        self.plain = len(self.ids) == len(x)  # without repeated tokens
        if self.plain:
            self.ids, self.last = x, np.arange(len(x))
            self.first = self.last
        else:
            self.last = len(x) - 1 - np.unique(x[::-1], return_index=True)[1]


def _windows_of(job: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the key, place and whether the key is large of each window of a job's texts."""
    lists = job.column("windows").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    key, c, large = (lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("key", "c", "large"))
    return row, np.unique(key, return_inverse=True)[1], c, large


def _meeting(job: pa.Table) -> pa.Table:
    """The texts of the job that have a large key in common with one of the other side, or of the same if there is one only."""
    row, key, _, large = _windows_of(job)
    if not len(key):
        return job.slice(0, 0)
    side = job.column("side").to_numpy() if not job.column("own")[0].as_py() else np.arange(job.num_rows)
    row, key = row[large], key[large]
    least, most = np.full(key.max(initial=0) + 1, 1 << 62), np.full(key.max(initial=0) + 1, -1)
    np.minimum.at(least, key, side[row])
    np.maximum.at(most, key, side[row])
    return job.take(pa.array(np.unique(row[least[key] != most[key]])))


def _classes(job: pa.Table) -> tuple[list[_Class], np.ndarray, set[int]]:
    """The classes, of each token's number whether two texts of the job have it, and the large keys.

    Tokens that no other text of the job has are told apart, within a class, by the first of them that is equal."""
    job = job.sort_by("t")  # so that no result depends on the order of rows
    xs = [x.values.to_numpy() for x in job.column("x")]
    ends = np.cumsum([0, *(len(x) for x in xs)])
    ids = np.unique(np.concatenate(xs), return_inverse=True)[1]
    of = np.repeat(np.arange(len(xs)), np.diff(ends))
    first, last = (np.zeros(ids.max(initial=-1) + 1, dtype=np.int64) for _ in "ab")
    first[ids[::-1]] = np.arange(len(ids))[::-1]
    last[ids] = np.arange(len(ids))
    met = of[first] != of[last]
    row, key, c, large = _windows_of(job)
    both = np.unique(key.astype(np.int64) * len(xs) + row)
    chosen = (np.bincount(both // len(xs)) > 1)[key]
    large = set(key[large].tolist())
    row, key, c = row[chosen], key[chosen], c[chosen]
    order = np.lexsort((c, key, row))
    row, key, c = row[order], key[order], c[order]
    cut = np.searchsorted(row, np.arange(len(xs) + 1))
    found = {}
    for i, (t, low, side) in enumerate(zip(*(job.column(z).to_pylist() for z in ("t", "l", "side")), strict=True)):
        x = ids[ends[i] : ends[i + 1]]
        hit = met[x].nonzero()[0]
        if not len(hit):
            continue
        more = int(hit[-1] - hit[0]) // 8 + 2  # a span of density 8 / 9 reaches no farther
        a = max(int(hit[0]) - more, 0)
        x = x[a : int(hit[-1]) + more + 1]
        keys, places = key[cut[i] : cut[i + 1]], c[cut[i] : cut[i + 1]] - (low + a)
        own = ~met[x]
        shape = x.copy()
        shape[own] = -1 - (first[x[own]] - (ends[i] + a)) % (1 << 31)
        name = (shape.tobytes(), keys.tobytes(), places.tobytes())
        if name not in found:
            by_key = defaultdict(list)
            for k, z in zip(keys.tolist(), places.tolist(), strict=True):
                by_key[k].append(z)
            found[name] = _Class(x, by_key)
        found[name].texts[side].append((t, low + a))
    return list(found.values()), met, large


def _chains(one: _Class, two: _Class) -> list[list[tuple[int, int]]]:
    """The common windows of two classes that ``regions`` puts into one region each, as places in both; most first."""
    met = sorted((c1 - c2, c1, c2) for k in one.places.keys() & two.places.keys() for c1 in one.places[k] for c2 in two.places[k])
    chains = []
    for i, (d, c1, c2) in enumerate(met):
        if not (i and d - met[i - 1][0] <= DRIFT and abs(c1 - met[i - 1][1]) <= GAP):
            chains.append([])
        chains[-1].append((c1, c2))
    return sorted(chains, key=len, reverse=True)


def _hulls_merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for p, q in sorted(spans):
        if out and p < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], q)
        else:
            out.append((p, q))
    return out


def _linked(one: _Class, two: _Class, y: np.ndarray, marks: _Marks) -> tuple[list[tuple[int, int]], list[tuple[int, int]], float]:
    """The passages of each of two classes that the other has too, and their greatest similarity. ``y``: the second's tokens.

    Where both repeat a passage, each of its places is compared until it is linked, not with all of the other's.
    """
    chains, mine, theirs, most = _chains(one, two), [], [], 0.0
    free = lambda c, spans: not any(p <= c < q for p, q in spans)
    for need in (all, any) if len(chains) > 1 else (any,):
        left = []  # a chain that was compared gives nothing new
        for chain in chains:
            if not any(need((free(c1, mine), free(c2, theirs))) for c1, c2 in chain):
                left.append(chain)
                continue
            (a, b), (c, d) = ((max(min(z) - MARGIN, 0), max(z) + MARGIN + 1) for z in zip(*chain, strict=True))
            for p, q, u, v, s in _passages(one.x[a:b], y[c:d], marks):
                mine.append((a + p, a + q))
                theirs.append((c + u, c + v))
                most = max(most, s)
        chains = left
    return _hulls_merged(mine), _hulls_merged(theirs), most


def _may_hold(hits: np.ndarray) -> np.ndarray:
    """Of each row: whether it has a span of ``TOKENS`` places or more of the first density; without one there is no passage."""
    p, q = DENSE[0]
    total = np.zeros((len(hits), hits.shape[1] + 1), dtype=np.int32)
    np.cumsum(np.where(hits, q - p, -p), axis=1, out=total[:, 1:])
    if total.shape[1] <= TOKENS:
        return np.zeros(len(hits), dtype=bool)
    return (total[:, TOKENS:] >= np.minimum.accumulate(total, axis=1)[:, :-TOKENS]).any(axis=1)


#: Bytes of the table of a job's tokens and some of its classes.
HELD = 64 << 20


class _Alike:
    """Of a text and what it has in common with others: whether a span of ``TOKENS`` places has ``LEAST`` of its different tokens in common."""

    def __init__(self, x: np.ndarray):
        before, place = _repeats(x), np.arange(len(x))
        first = place if before is None else before + 1
        # A place is new in the spans that begin after the last one before it with its number.
        first = np.maximum(first, place - TOKENS + 1).clip(0) if before is not None else (place - TOKENS + 1).clip(0)
        starts = np.arange(max(len(x) - TOKENS + 1, 0))
        self.order = first.argsort(kind="stable")
        self.upto = first[self.order].searchsorted(starts, side="right")
        self.least = LEAST * (self.upto - starts) - 1e-9

    def any(self, hits: np.ndarray) -> np.ndarray:
        """Of each row of ``hits``."""
        passed, begun = (np.zeros((len(hits), hits.shape[1] + 1), dtype=np.int32) for _ in "ab")
        hits.cumsum(axis=1, out=passed[:, 1:])
        hits[:, self.order].cumsum(axis=1, out=begun[:, 1:])
        return (begun[:, self.upto] - passed[:, : len(self.upto)] >= self.least).any(axis=1)


def _may_meet(classes: list[_Class], met: np.ndarray, meet: np.ndarray) -> np.ndarray:
    """The pairs of classes in ``meet`` of which each has a span dense enough in what the other holds, and one of ``TOKENS`` places whose
    different tokens are, to ``LEAST``. A passage needs both: a token that isn't in common holds words of those around it, so it
    counts in every span that lies there, however often its neighbours are repeated."""
    n, may, meet = len(classes), np.zeros_like(meet), meet.copy()
    at = np.where(met, np.cumsum(met) - 1, np.count_nonzero(met))  # tokens that one text has hit nothing: the last column
    xs = [at[c.x] for c in classes]
    width = np.count_nonzero(met) + 1
    alike = [None if c.plain else _Alike(c.x) for c in classes]
    step = max(HELD // width, 1)
    for begin in range(0, n, step):
        holds = np.zeros((min(step, n - begin), width), dtype=bool)
        for j in range(len(holds)):
            holds[j, xs[begin + j]] = True
        holds[:, -1] = False
        for i, x in enumerate(xs):
            near = meet[i, begin : begin + step].nonzero()[0]
            if len(near):
                for part in np.array_split(near, -(-len(near) * len(x) // 4_000_000)):
                    hits = holds[part[:, None], x]
                    dense = _may_hold(hits).nonzero()[0]
                    if len(dense):
                        may[i, begin + part[dense]] = True if classes[i].plain else alike[i].any(hits[dense])
                meet[begin + near, i] &= may[i, begin + near]  # a pair that fails on one side isn't looked at on the other
    return meet & may & may.T


def _by_runs(x: np.ndarray, y: np.ndarray, n: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages of pairs of texts without repeated tokens by their runs in common (``x`` and ``y`` their places, ``n`` their lengths),
    which have the same order in both; a pair has ``count`` of them from ``begin`` on. The longest dense hull of runs is taken first,
    then what lies on either side. Gives (pair, p, q, u, v, similarity) as columns, and the pairs of which it can't tell."""
    x, y, n = (z.astype(np.int32) for z in (x, y, n))
    total = np.append(0, n.cumsum()).astype(np.int32)
    out, unclear = [np.empty((6, 0))], np.zeros(len(begin), dtype=bool)
    pair, lo, hi = np.arange(len(begin)), begin, begin + count
    while len(pair):
        enough = ((total[hi] - total[lo]) * DENSE[0][1] >= TOKENS * DENSE[0][0]) & ~unclear[pair]
        order = (hi - lo)[enough].argsort(kind="stable")
        pair, lo, hi = (z[enough][order] for z in (pair, lo, hi))
        more = []
        while len(pair):  # as many at once as have a table of bounded size
            width = (hi - lo)[: max(TABLE // int((hi - lo)[-1]) ** 2, 1)]
            k, r = len(width), int(width[-1])
            at = np.minimum(lo[:k, None] + np.arange(r), hi[:k, None] - 1)
            first, end, cut = x[at], x[at] + n[at], np.arange(r) < width[:, None]
            hulls = cut[:, None, :] & cut[:, :, None] & (np.arange(r) >= np.arange(r)[:, None])
            length = end[:, None, :] - first[:, :, None]
            todo = np.arange(k)
            for num, den in DENSE:
                dense = hulls[todo] & ((den * total[at + 1] - num * end)[todo][:, None, :] >= (den * total[at] - num * first)[todo][:, :, None])
                i, j = np.divmod(np.where(dense, length[todo], -1).reshape(len(todo), r * r).argmax(axis=1), r)
                i, j = lo[todo] + i, lo[todo] + j
                both, own, other = total[j + 1] - total[i], x[j] + n[j] - x[i], y[j] + n[j] - y[i]
                s = both / (own + other - both)
                found = (np.minimum(own, other) >= TOKENS) & (both * den >= other * num) & (s >= LEAST)
                out.append(np.stack([z[found] for z in (pair[todo], x[i], x[i] + own, y[i], y[i] + other, s)]))
                more += [(pair[todo][found], lo[todo][found], i[found]), (pair[todo][found], j[found] + 1, hi[todo][found])]
                todo = todo[~found]
            # A hull that is too short may yet be a passage with what stands around it.
            num, den = DENSE[0]
            hits = (total[at + 1][:, None, :] - total[at][:, :, None])[todo]
            may = (hulls[todo] & (hits * den >= TOKENS * num) & (hits * den >= length[todo] * num)).any(axis=(1, 2))
            unclear[pair[todo][may]] = True
            pair, lo, hi = pair[k:], lo[k:], hi[k:]
        if more:
            pair, lo, hi = (np.concatenate(z) for z in zip(*more, strict=True))
    found = np.concatenate(out, axis=1)
    return found[:, ~unclear[found[0].astype(np.int64)]], unclear


class _Pairs:
    """One class with all others that it meets: a few operations on arrays tell most of their passages. Tokens lie once for each class,
    with their first and last place there and how often they occur."""

    def __init__(self, classes: list[_Class], n: int, marks: _Marks):
        self.classes, self.marks, self.at = classes, marks, np.full(n, -1)
        self.plain, self.size = np.array([c.plain for c in classes], dtype=bool), np.array([len(c.ids) for c in classes], dtype=np.int64)
        self.low = np.cumsum(self.size) - self.size
        self.first, self.last, self.times = (np.concatenate([getattr(c, z) for c in classes] or [[]]) for z in ("first", "last", "times"))

    def passages(self, i: int, near: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Of class ``i`` with each of ``near``: (j, p, q, u, v, similarity) where all that they have in common is one passage
        or runs tell the passages, as columns; and the others that may have some."""
        own, size = self.classes[i].ids, self.size[near]
        start = np.cumsum(size) - size
        self.at[own] = self.low[i] + np.arange(len(own))
        at = self.at[np.concatenate([self.classes[j].ids for j in near.tolist()])]
        self.at[own] = -1
        hit = (at >= 0).nonzero()[0]
        n = np.diff(hit.searchsorted(start + size), prepend=0)
        near, shift, n = near[n > 0], (self.low[near] - start)[n > 0], n[n > 0]
        if not len(near):
            return np.empty((6, 0)), []
        at, there, low = at[hit], hit + np.repeat(shift, n), np.cumsum(n) - n
        mine, theirs = np.add.reduceat(self.times[at], low), np.add.reduceat(self.times[there], low)
        p, q = np.minimum.reduceat(self.first[at], low), np.maximum.reduceat(self.last[at], low) + 1
        u, v = np.minimum.reduceat(self.first[there], low), np.maximum.reduceat(self.last[there], low) + 1
        # What doesn't hit is as many different tokens as it has places, at most.
        s = n / (np.minimum(n + q - p - mine, self.size[i]) + np.minimum(n + v - u - theirs, self.size[near]) - n)
        whole = (np.minimum(q - p, v - u) >= TOKENS) & _is_dense(mine, q - p) & _is_dense(theirs, v - u) & (s >= LEAST)
        plain = self.plain[near] & self.plain[i]
        for k in (whole & ~plain & (s < 1)).nonzero()[0].tolist():
            s[k] = self.marks.similarity(self.classes[i].x[p[k] : q[k]], self.classes[near[k]].x[u[k] : v[k]])
        left = ~whole & _is_dense(np.minimum(mine, theirs), TOKENS)
        found, others = [np.stack([z[whole] for z in (near, p, q, u, v, s)])], near[left & ~plain].tolist()
        left &= plain
        if left.any():
            new = np.ones(len(at), dtype=bool)
            new[1:] = (np.diff(at) != 1) | (np.diff(there) != 1)
            new[low] = True
            run = new.nonzero()[0]
            begin, n_runs = run.searchsorted(low), np.add.reduceat(new, low, dtype=np.int64)
            falls = np.append(False, np.diff(at[run]) < 0)
            falls[begin] = False
            told = left & (n_runs <= RUNS) & ~np.logical_or.reduceat(falls, begin)
            others += near[left & ~told].tolist()
            if told.any():
                place = there[run] - np.repeat(self.low[near], n_runs)
                by_runs, unclear = _by_runs(at[run] - self.low[i], place, np.diff(np.append(run, len(at))), begin[told], n_runs[told])
                others += near[told][unclear].tolist()
                by_runs[0] = near[told][by_runs[0].astype(np.int64)]
                found.append(by_runs)
        return np.concatenate(found, axis=1), others


class _Found:
    """Passages of classes, with their partners."""

    def __init__(self, n: int):
        self.root, self.parts, self.rows = np.arange(n), [], []

    def linked(self, i: int, others: np.ndarray) -> None:
        names = self.root[others]
        if (names != self.root[i]).any():
            names = np.unique(np.append(names, self.root[i]))
            self.root[np.isin(self.root, names)] = names[0]

    def add(self, i: int, j: np.ndarray, p, q, u, v, s) -> None:
        """Class i's passages p:q and those u:v of the classes j are linked."""
        each = np.full(len(j), float(i))
        self.parts += [np.stack([each, j, p, q, s]), np.stack([j, each, u, v, s])]
        self.linked(i, j.astype(np.int64))

    def merged(self, sizes: np.ndarray, own: bool) -> Iterator[tuple[int, int, int, int, int, float]]:
        """class, side, first, end, number of links and greatest similarity; overlapping passages of a class as one. ``sizes``: texts of each side and class."""
        of, partner, p, q, s = np.concatenate([*self.parts, np.array(self.rows, dtype=np.float64).reshape(-1, 5).T], axis=1)
        of, partner, p, q = (z.astype(np.int64) for z in (of, partner, p, q))
        for side in (0,) if own else (0, 1):
            n = sizes[0 if own else 1 - side][partner] - (own & (of == partner))
            has = ((n > 0) & (sizes[side][of] > 0)).nonzero()[0]
            if not len(has):
                continue
            has = has[np.lexsort((q[has], p[has], of[has]))]
            first, end = p[has], q[has] + SHINGLE - 1  # they overlap if their words do
            step = int(end.max()) + 1
            reach = np.maximum.accumulate(of[has] * step + end)
            new = np.ones(len(has), dtype=bool)
            new[1:] = of[has][1:] * step + first[1:] >= reach[:-1]
            at = new.nonzero()[0]
            ends = np.maximum.reduceat(q[has], at)
            rows = of[has][at], first[at], ends, np.add.reduceat(n[has], at), np.maximum.reduceat(s[has], at)
            yield from ((c, side, *rest) for c, *rest in zip(*(z.tolist() for z in rows), strict=True))


_COUNTED = "t long, start_word int, end_word int, n_links long, similarity double, other long"


def _counted(job: pa.Table) -> pa.Table:
    """All pairs of texts of two blocks (or of one) that have a large key in common, verified by classes, and counted for each passage.

    other: one of the texts that the job's links lead to, the same for all of them."""
    own = job.column("own")[0].as_py()
    job = _meeting(job)
    classes, met, large = _classes(job) if job.num_rows else ([], np.zeros(0, dtype=bool), set())
    n = len(classes)
    meet, by_key = np.zeros((n, n), dtype=bool), defaultdict(list)
    for i, c in enumerate(classes):
        for k in c.places.keys() & large:
            by_key[k].append(i)
    for at in by_key.values():
        meet[np.ix_(at, at)] = True
    sizes = np.array([[len(c.texts[s]) for c in classes] for s in (0, 1)], dtype=np.int64)
    has = sizes > 0
    if own:
        meet &= ~np.diag(sizes[0] == 1)
    else:
        meet &= (has[0][:, None] & has[1]) | (has[1][:, None] & has[0])
    found, marks, others = _Found(n), _Marks(2 * len(met)), meet & np.eye(n, dtype=bool)
    pairs = _Pairs(classes, len(met), marks)
    for i in range(n):
        near = meet[i, i + 1 :].nonzero()[0] + i + 1
        if len(near):
            spans, rest = pairs.passages(i, near)
            others[i, rest] = others[rest, i] = True
            if spans.shape[1]:
                found.add(i, *spans)
    others = np.triu(_may_meet(classes, met, others))
    for i, j in zip(*(z.tolist() for z in others.nonzero()), strict=True):
        one, two = classes[i], classes[j]
        y = two.x if i != j else np.where(met[two.x], two.x, two.x + len(met))  # two texts of a class have own tokens each
        mine, theirs, s = _linked(one, two, y, marks)
        found.rows += [(i, j, p, q, s) for p, q in mine] + [(j, i, u, v, s) for u, v in theirs if i != j]
        if mine:
            found.linked(i, np.array([j]))
    least, out = {}, []
    for r, c in zip(found.root.tolist(), classes, strict=True):
        least[r] = min(least.get(r, 1 << 63), *(t for t, _ in itertools.chain(*c.texts)))
    for c, side, p, q, links, s in found.merged(sizes, own):
        out += [(t, low + p, low + q + SHINGLE - 1, links, s, least[int(found.root[c])]) for t, low in classes[c].texts[side]]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["t", "start_word", "end_word", "n_links", "similarity", "other"])


def counted(met: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """t, start_word, end_word, n_links, similarity, other: the passages of ``met`` (``members``), for each pair of blocks with a large key in common."""
    keys = written(met.select("block", F.explode("keys").alias("key")).distinct(), "block-keys")
    jobs = keys.join(keys.toDF("_block", "_key"), (F.col("key") == F.col("_key")) & (F.col("block") <= F.col("_block"))).select("block", "_block").distinct()
    jobs = written(jobs.toDF("a", "b"), "jobs")
    hulls = _with_texts(met.select("t", "windows"), docs, ids, "windows").mapInArrow(_hulls, "_t long, l int, x array<int>")
    texts = written(met.join(hulls, F.col("t") == F.col("_t")).select("t", "block", "windows", "keys", "l", "x"), "members")
    own = (F.col("a") == F.col("b")).alias("own")
    dealt = jobs.select("a", "b", own, F.col("a").alias("_block"), F.col("b").alias("_other"), F.lit(0).alias("side"))
    dealt = dealt.union(jobs.where("a <> b").select("a", "b", own, "b", "a", F.lit(1)))
    dealt = texts.join(dealt, F.col("block") == F.col("_block")).drop("block", "_block")
    others = keys.groupBy(F.col("block").alias("_with")).agg(F.collect_list("key").alias("_keys"))
    if small_enough(others):  # else texts that meet none of the other block are left out by the tasks only
        dealt = dealt.join(F.broadcast(others), F.col("_other") == F.col("_with")).where(F.arrays_overlap("keys", "_keys")).drop("_with", "_keys")
    return dealt.drop("keys", "_other").groupBy("a", "b").applyInArrow(_counted, _COUNTED)


def linked_passages(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """t, start_word, end_word, n_links, similarity, other: passages that another text has too, n_links verified links of each. ``ids``: text_hash, least (doc_id).

    ``other`` is linked with the text, straight or by way of others."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    shared = written(shared_windows(texts.select("text_hash", "text")), "shared")
    met = written(members(shared), "blocks")
    pairs = written(regions(window_links(shared)), "regions")
    # Pairs with a large key in common are counted with their blocks.
    keys = [met.select(F.col("t").alias(f"_t{i}"), F.col("keys").alias(f"_keys{i}")) for i in (1, 2)]
    pairs = pairs.join(keys[0], F.col("t1") == F.col("_t1"), "left").join(keys[1], F.col("t2") == F.col("_t2"), "left")
    pairs = written(pairs.where(~F.coalesce(F.arrays_overlap("_keys1", "_keys2"), F.lit(False))).select("t1", "l1", "r1", "t2", "l2", "r2"), "pairs")
    found = written(verified(pairs, texts, ids), "passages")
    each = found.select(F.col("t1").alias("t"), F.col("s1").alias("start_word"), F.col("e1").alias("end_word"), F.lit(1).cast("long").alias("n_links"), "similarity", F.col("t2").alias("other"))
    each = merged(each.union(found.select("t2", "s2", "e2", F.lit(1).cast("long"), "similarity", "t1")), "other")
    each = each.select("t", "start_word", "end_word", F.lit(1).cast("long").alias("n_links"), "similarity", "other")  # a partner counts once
    return each.union(written(counted(met, texts, ids), "counted"))


def merged(spans: DataFrame, *by: str) -> DataFrame:
    """t, start_word, end_word, n_links, similarity and the columns ``by``: overlapping spans of a text as one, for each value of these."""
    order = Window.partitionBy("t", *by).orderBy("start_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = spans.withColumn("_new", F.coalesce(F.col("start_word") >= before, F.lit(True)).cast("int"))
    df = df.withColumn("_at", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy("t", *by, "_at").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.sum("n_links").alias("n_links"), F.max("similarity").alias("similarity")).drop("_at")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), class_id, n_links, similarity: passages that another document has too.

    class_id is the smallest doc_id that is linked to the document by passages;
    n_links counts the texts that its text's passage is linked with (one for each of the spans that
    make it up which share no word), similarity is the greatest. A whole text that has copies is a passage of similarity 1.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).alias("n_words")).distinct(), "texts")
    ids = written(own.groupBy("text_hash").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words")), "text-classes")
    found = linked_passages(docs, ids.select("text_hash", "least"))
    nodes = components(found.select(F.col("t").alias("u"), F.col("other").alias("v")))
    named = written(nodes.join(ids, F.col("node") == F.col("text_hash")).select("node", "root", "least"), "nodes")
    roots = named.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = named.select("node", "root").join(written(roots, "roots"), "root").select(F.col("node").alias("t"), "class_id")
    each = found.groupBy("t", "start_word", "end_word").agg(F.sum("n_links").alias("n_links"), F.max("similarity").alias("similarity"))
    whole = ids.where((F.col("copies") > 1) & (F.col("n_words") >= WORDS))
    whole = whole.select(F.col("text_hash").alias("t"), F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), (F.col("copies") - 1).alias("n_links"), F.lit(1.0).alias("similarity"))
    spans = merged(each.union(whole))
    least = ids.select(F.col("text_hash").alias("_h"), "least")
    spans = written(spans.join(classes, "t", "left").join(least, F.col("t") == F.col("_h")).select("t", "start_word", "end_word", F.coalesce("class_id", "least").alias("class_id"), "n_links", "similarity"), "classed")
    return own.join(spans, F.col("text_hash") == F.col("t")).select("doc_id", "start_word", "end_word", "class_id", "n_links", "similarity")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
