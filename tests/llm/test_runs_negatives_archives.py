"""Periodic runs, hard negatives and archives against plain Python."""

import gzip
import hashlib
import random
import zlib
from collections import Counter
from glob import glob

import numpy as np
import pandas as pd
import pytest

from terracurve.llm import hard_negatives, periodic, warc
from terracurve.llm.common import words
from tests.compare import DATA, duck, duck_rows, spark_rows


def brute_runs(w, exponent=4, least=6):
    """Every stretch that keeps a period, by trying all of them."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, exponent * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic_words(rng):
    n, k = rng.randrange(90), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    if n > 8 and rng.random() < 0.6:
        a, p = rng.randrange(n - 4), rng.randrange(1, 8)
        for i in range(a + p, n):
            w[i] = w[i - p] if rng.random() < 0.98 else w[i]
    return w


def test_runs_of_words():
    rng = random.Random(1)
    for _ in range(1500):
        w, exponent, least = periodic_words(rng), rng.choice([3, 4, 5]), rng.choice([3, 6, 10])
        assert periodic.runs(np.array(w, dtype=np.int64), exponent, least) == brute_runs(w, exponent, least)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    assert periodic.runs(np.array(fib[-1]), 3, 6) == brute_runs(fib[-1], 3, 6) != []  # dense in runs of low exponent


def test_runs_of_long_texts():
    n = 200_000
    assert periodic.runs(np.zeros(n, dtype=np.int64)) == [(0, n, 1)]
    assert periodic.runs(np.arange(n) % 7) == [(0, n, 7)]
    assert periodic.runs(np.r_[np.arange(500), np.arange(n) % (n // 5)])[-1] == (500, n, n // 5)
    # One phrase with another word before and after it each time: many classes, no run.
    phrase = [x for i in range(4000) for x in (1000 + i, 0, 1, 2, 3, 4, 5, 6)]
    assert periodic.runs(np.array(phrase)) == []


def expected_runs(doc_id, text):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", text or "") if x]
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found, dropped = brute_runs(w), set()
    for s, length, q in found:
        dropped |= set(range(s + q, s + length))
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    runs = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(runs), sha(" ".join(x for i, x in enumerate(w) if i not in dropped))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"é{x}" for x in periodic_words(rng)) for _ in range(400)]
    texts += [None, "", " \n\t ", "one", "a " * 900, "a b c\x85d \x1c e " * 6, "same line here\n" * 40, "a b c d a b c d a b c d a b c d x x x x x x"]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[5], "x", 1, 2), (None, "b " * 20, "x", 1, 2), (-7, texts[8], "x", 1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, h int, w int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op12_runs(spark, str(tmp_path)).select(*COLUMNS).collect()]
    assert Counter(got) == Counter(expected_runs(r[0], r[1]) for r in rows)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 20


def test_runs_query_on_the_tables(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 3000").collect()
    wanted = {expected_runs(r["doc_id"], r["text"]) for r in rows}
    got = {tuple(r) for r in periodic.op12_runs(spark, str(DATA)).select(*COLUMNS).collect()}
    assert wanted <= got and len(wanted) > 100


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "go  go go go go go\nnow"), (2, None)], "doc_id long, text string")
    one, two = periodic.periodic_runs(docs).orderBy("doc_id").collect()
    assert (one["n_words"], [tuple(r) for r in one["runs"]], one["collapsed"]) == (7, [(0, 6, 1)], "go now")
    assert (two["n_words"], two["runs"], two["collapsed"]) == (0, [], "")
    assert periodic.periodic_runs(docs, 3, 7).where("doc_id = 1").first()["runs"] == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, 2)
    assert periodic.digests(periodic.periodic_runs(docs.where("false"))).collect() == []
    assert spark.createDataFrame([("a b",)], "t string").select(words(__import__("pyspark").sql.functions.col("t"))).first()[0] == ["a", "b"]


def brute_negatives(rows, positives=5, negatives=3):
    """rows: vec_id, vector, label."""
    bad = lambda v: v is None or any(x is None or not np.isfinite(x) for x in v)
    own = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v], c) for i, v, c in rows if i is not None and c is not None and not bad(v)]
    out = []
    for a, (i, x, c) in enumerate(own):
        if i % 50:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y, strict=True)), j, d) for b, (j, y, d) in enumerate(own) if a != b and len(x) == len(y)]
        for s, j, _ in sorted(r for r in scores if r[2] == c)[:positives]:
            fit = sorted((t, k) for t, k, d in scores if d != c and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(fit, 1)]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, row string, cluster int")


def some_vectors(rng, n, dim=6, spread=0.4):
    heads = rng.normal(size=(5, dim))
    return [(i, (heads[i % 5] + spread * rng.normal(size=dim)).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("shard", [90, 8192])
def test_hard_negatives_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 8 if shard == 90 else 16_384)
    rng = np.random.default_rng(4)
    rows = some_vectors(rng, 700)
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 3) for i in range(350)]  # a third of all rows
    rows += [(2000, None, 1), (2001, [1.0, None] * 3, 1), (2050, [float("nan")] * 6, 1), (2100, [float("inf")] * 6, 0), (2150, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(2200, [0.0] * 6, 1), (2250, [], 1), (2251, [], 2), (2300, [1.0, 2.0], 0), (2301, [1.0, 2.0], 0), (2302, [0.9, 1.5], 1), (-50, rows[7][1], 2), rows[50], rows[50], (150, rows[9][1], 1)]
    got = Counter(tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect())
    assert got == brute_negatives(rows) and got.total() > 100


def test_hard_negatives_of_huge_components_and_of_none(spark):
    rows = [(50 * i, [2.0**21 + 2.0**18 * i, -(2.0**20), float(i)], i % 2) for i in range(12)]
    assert Counter(tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect()) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(vectors(spark, []), every=1).collect() == []
    assert hard_negatives.hard_negatives(vectors(spark, [(50, [1.0], 1)])).collect() == []


def test_walks_end_early_and_miss_nothing():
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(8, 32))
    x = np.floor(256 * (heads[np.arange(6000) % 8] + 0.15 * rng.normal(size=(6000, 32))))
    shard = {"x": x, "id": rng.permutation(6000), "row": np.arange(6000), "label": rng.integers(0, 3, 6000)}
    own = np.arange(0, 640, 8)  # all of the first head
    asks = {"x": x[own], "norm": np.linalg.norm(x[own], axis=1), "row": own, "label": shard["label"][own], "low": np.full((80, 1), hard_negatives.NONE + 1), "high": np.full((80, 1), np.iinfo(np.int64).max)}
    shared = hard_negatives.Shared(x, np.linalg.norm(x, axis=1), asks["x"], asks["norm"])
    tops, scored = hard_negatives._walk(shared, shard, asks, 0, 5)
    assert scored < 0.5 * 80 * 6000
    plain = hard_negatives._plain(shard, asks, 0, 5)
    assert (tops[0][0] == plain[0][0]).all() and (tops[0][1] == plain[0][1]).all()
    edge = np.sort(tops[0][0], axis=1)[:, ::-1]
    asks |= {"low": np.ceil(edge * 0.5).astype(np.int64), "high": np.floor(edge * 0.95).astype(np.int64)}
    tops, _ = hard_negatives._walk(shared, shard, asks, 5, 3)
    plain = hard_negatives._plain(shard, asks, 5, 3)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(tops, plain, strict=True))


def test_negatives_within_one_task_of_many_steps():
    rng = np.random.default_rng(5)
    rows = [(i, v, c) for i, v, c in some_vectors(rng, 1500, 8)]
    x = np.floor(256 * np.array([np.float32(v) for _, v, _ in rows], dtype=np.float64))
    frame = pd.DataFrame({"row": np.arange(1500), "vec_id": np.arange(1500), "label": [c for *_, c in rows], "v": list(x)})
    asks = frame[frame["vec_id"] % 50 == 0].assign(cluster=0, low=[[hard_negatives.NONE + 1]] * 30, high=[[2**62]] * 30)
    got = hard_negatives.search_block(frame, asks, 0, 5)
    for a in asks.itertuples():
        scores = (x @ a.v).astype(np.int64)
        like = [(-int(scores[j]), j) for j in range(1500) if rows[j][2] == a.label and j != a.row]
        own = got[got["anchor"] == a.row]
        assert sorted(zip(-own["score"], own["vec_id"], strict=True)) == sorted(like)[:5]


PAGES = "page_id long, url string, html string, digest string, refers_to string"


@pytest.fixture(scope="module")
def pages():
    long_, other = "x" * 999 + "é", "y" * 1000
    rows = [(i, f"http://h{i % 3}.org/{i}", t) for i, t in enumerate([long_, long_, "short", "short", None, "", other, long_, "WARC/1.1\r\n\r\n" * 200, "z" * 999, "z" * 999, "é" * 700, "a\u0000b"])]
    rows += [(40, None, other), (41, "http://a b/\r\nWARC-Type: x", "q" * 3000), (6, "http://again", other), (None, "http://n/1", long_), (None, "http://n/2", "n" * 2000), (None, "http://n/3", "n" * 2000), (-3, "u", long_)]
    return [(*r, "x", "y") for r in rows]


def expected_pages(rows):
    body = [(i, (t or "").encode()) for i, _, t, *_ in rows]
    most = {}
    for i, b in body:
        if i is not None:
            most[b] = max(most.get(b, i), i)
    for i, b in body:
        to = most.get(b) if len(b) >= 1000 else None
        to = None if to == i else to
        yield i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to


@pytest.mark.parametrize("parts", [1, 5])
def test_archives_round_trip(spark, pages, tmp_path, parts):
    df = spark.createDataFrame(pages, PAGES).repartition(parts)
    index = warc.archive(warc.typed(df), f"file://{tmp_path}/archives", most=20_000)
    got = warc.fetched(index).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(expected_pages(pages))
    assert Counter(bytes(r["payload"]) for r in got if r["record_type"] == "response") == Counter((t or "").encode() for (*_, kind, _), (_, _, t, *_) in zip(expected_pages(pages), pages, strict=True) if kind == "response")
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")
    assert {r["url"] for r in got} >= {None, "http://a%20b/%0D%0AWARC-Type:%20x"}
    assert {r["url"] for r in index.collect()} == {r[1] for r in pages}
    # The files are gzip members in a row, with nothing between them, and records stand where the index says.
    files = glob(f"{tmp_path}/archives/*.warc.gz")
    assert sum(gzip.open(f).read().count(b"WARC-Payload-Digest") for f in files) == len(pages)
    for r in index.collect():
        with open(r["file"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            assert warc.parsed(f.read(r["length"]))["payload_digest"] == r["digest"]


def test_selected_records_and_their_reads(spark, pages, tmp_path):
    index = warc.archive(warc.typed(spark.createDataFrame(pages, PAGES).coalesce(1)), f"file://{tmp_path}/some")
    got = warc.fetched(index.where("url = 'http://h2.org/8'"), gap=0, stretch=10).collect()
    assert [r["page_id"] for r in got] == [8] and bytes(got[0]["payload"]) == b"WARC/1.1\r\n\r\n" * 200
    assert sum(1 for _ in warc.fetched(index.where("record_type = 'revisit'"), payloads=False).collect()) == 6
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 46, 100), ("b", 146, 1), ("b", 147, 1)]
    assert [(f, s, e, len(m)) for f, s, e, m in warc.coalesced(rows, 4, 50)] == [("a", 0, 15, 2), ("a", 40, 45, 1), ("a", 46, 146, 1), ("b", 146, 148, 2)]
    assert [(s, e) for _, s, e, _ in warc.coalesced(rows[:3], 25, 50)] == [(0, 45)]
    assert list(warc.coalesced([])) == []


def test_broken_records_are_refused():
    body = b"p" * 50
    good = warc.record(1, "u", body, hashlib.sha1(body).hexdigest(), None)
    assert warc.parsed(good)["payload"] == body
    with pytest.raises(ValueError):
        warc.parsed(warc.record(1, "u", body, hashlib.sha1(b"other").hexdigest(), None))
    with pytest.raises(ValueError):
        warc.parsed(gzip.compress(gzip.decompress(good).replace(b"Content-Length: 50", b"Content-Length: 49")))
    with pytest.raises((ValueError, EOFError)):
        warc.parsed(good[:-20])


def test_archives_of_no_pages(spark):
    index = warc.archive(warc.typed(spark.createDataFrame([], PAGES)))
    assert index.collect() == [] == warc.fetched(index).collect()


@pytest.mark.parametrize("query, sql", [(hard_negatives.op11_hard_negatives, hard_negatives.SQL), (warc.op13_warc, warc.SQL)])
def test_sql_of_the_tables(spark, query, sql):
    assert spark_rows(query(spark, str(DATA))) == duck_rows(duck().sql(sql))
