"""Near-duplicates by word shingles, held against brute force, and edited copies in the pipeline."""

import random

import numpy as np

import corpus_pipeline
from shockwell.llm import shingles

DOCS = "doc_id long, text string, lang string"


def edited(r, words, text, n):
    """`text` with n words replaced."""
    out = text.split()
    for k in r.sample(range(len(out)), n):
        out[k] = r.choice(words)
    return " ".join(out)


def corpus(r):
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(2000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [text(r.randint(1, 300)) for _ in range(60)]
    for size, n in ((100, 1), (200, 1), (200, 4), (200, 5), (200, 8), (500, 5), (500, 10), (60, 1), (40, 1)) * 6:
        first = text(size)
        rows += [first, edited(r, words, first, n)]
    hot = text(150)
    return rows + [edited(r, words, hot, k % 6) for k in range(60)] + ["A b", "a  B", "a b c", "", None]


def slow_groups(texts):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if z in (x, y) else z for z in root]
    return dict(enumerate(root))


def test_shingle_groups(spark, odd_docs, no_docs, monkeypatch):
    texts = corpus(random.Random(5))
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], DOCS)
    want = slow_groups(texts)
    assert {x.doc_id: x.component_id for x in shingles.shingle_groups(docs).collect()} == want
    monkeypatch.setattr(shingles, "BLOCK", 7)  # buckets of many blocks
    assert {x.doc_id: x.component_id for x in shingles.shingle_groups(docs).collect()} == want
    assert shingles.shingle_groups(odd_docs).count() == odd_docs.count() and shingles.shingle_groups(no_docs).count() == 0


def test_pipeline_drops_edited_copies(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(2000)]
    firsts = [" ".join(r.choice(words) for _ in range(200)) for _ in range(30)]
    rows = [(k, t, "en") for k, t in enumerate(firsts)] + [(100 + k, edited(r, words, t, 1 + k % 4), "en") for k, t in enumerate(firsts)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert {x.doc_id for x in got.collect()} == set(range(30))


def test_fingerprints_link_texts(spark, monkeypatch):
    """Without bands, texts within the given bits are joined if 0.8 of their shingles are shared, and no others."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(2000)]
    firsts = [" ".join(r.choice(words) for _ in range(300)) for _ in range(40)]
    texts = [x for k, t in enumerate(firsts) for x in (t, edited(r, words, t, 1 + k % 20))]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], DOCS)
    sets = [shingles.shingle_set(t) for t in texts]
    bits = [shingles.set_fingerprint(s) for s in sets]
    share = [len(np.intersect1d(sets[k], sets[k + 1])) / len(np.union1d(sets[k], sets[k + 1])) for k in range(0, 80, 2)]
    apart = [(bits[k] ^ bits[k + 1]).bit_count() for k in range(0, 80, 2)]
    monkeypatch.setattr(shingles, "TURNS", ())
    for distance, cuts in ((4, 7), (16, 17)):
        monkeypatch.setattr(shingles, "DISTANCE", distance)
        monkeypatch.setattr(shingles, "CUTS", cuts)
        linked = [d <= distance and s >= 0.8 for d, s in zip(apart, share, strict=True)]
        assert any(linked) and not all(linked) and (distance == 4 or any(d <= distance and s < 0.8 for d, s in zip(apart, share, strict=True)))
        got = {x.doc_id: x.component_id for x in shingles.shingle_groups(docs).collect()}
        assert [got[2 * k + 1] == 2 * k for k in range(40)] == linked and all(got[2 * k] == 2 * k for k in range(40))
