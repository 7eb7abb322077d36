"""The pipeline against its stages in plain Python."""

import random
from collections import Counter

import corpus_pipeline
from terracurve.llm import mixing, packing, quality, secret_scan, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(800)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 120))) for _ in range(60)]
    texts += texts[:6] + ["short", None, "a*** b### c$$$ " * 20, "token=abcdef123 " + texts[10]]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "secrets", "mixing", "packing"]
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    one = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(one).collect()}
    two = corpus_pipeline.dedup_stage(spark, one, str(tmp_path))
    assert {r["doc_id"] for r in two.collect()} == set(comp.values())
    three = corpus_pipeline.secrets_stage(spark, two, str(tmp_path))
    assert three.count() == two.count() and not secret_scan.secrets(three).where("spans <> ''").count()
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.taken(three).collect()}
    four = corpus_pipeline.mixing_stage(spark, three, str(tmp_path))
    want = Counter({d: int(t / max(s, 1) + 0.5) for d, (t, s) in taken.items()})
    got = Counter(r["doc_id"] for r in four.collect())
    assert got == +want
    five = corpus_pipeline.packing_stage(spark, four, str(tmp_path))
    assert Counter(r["doc_id"] for r in five.collect()) == got
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(tuple(r) for r in packing.packed(four).collect())


def test_near_copies_go(spark):
    """Texts with one to six words changed, against brute force; most pairs of 0.8 or more lie beyond three bits."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(800)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(80, 160))]
        for n in (0, 1, 2, 3, 6):
            for at in rng.sample(range(len(base)), n):
                base = [*base[:at], f"new{n}", *base[at + 1 :]]
            texts.append(" ".join(base))
    texts += ["one two", "one  two", "one three", "", None]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in ((t or "").split() for t in texts)]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(None, texts[0], "en", "a", 0), (None, "only here", "en", "a", 0)], DOCS)
    got = Counter(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, df, "").collect())
    assert got == Counter({*root, None})
