"""Operators 11 to 13: the registered queries over small tables, and the operators over odd input, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shockwell.llm import alignment, negatives, passages, queries

EXTRA = "doc_id long, text string, row string, pair string, doc string, n_words string"


def texts():
    r = random.Random(5)
    pool = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    passage = text(40)
    out = [text(r.randint(1, 150)) for _ in range(80)]
    for k in range(0, 60, 4):
        out[k] = text(r.randint(0, 9)) + " " + passage[: r.randint(60, len(passage))] + "\t" + text(3)
    edited = out[5].split(" ")
    edited[len(edited) // 2] = "edited"
    out += [None, "", " ", "\n \t", "x", out[7], out[7], out[9] + " " + out[9], " ".join(edited), "é中文 " * 40, "a▁b", "<|endoftext|> and </s> <0x41>", "two  spaces\n\nand lines \r\n end ", "\nfirst", " lead", "nul\0l", "😀 smile ☺️ " * 5, "a " * 500, text(4000)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('tables')}"
    own = texts()
    spark.createDataFrame([(k, t, "r", "p", "d", "n") for k, t in enumerate(own)], EXTRA).repartition(3).write.parquet(f"{root}/documents.parquet")
    draw = np.random.default_rng(2)
    rows = [(k, (k * 7) % 10 if k % 13 else None, draw.normal(size=8).round(2).tolist()) for k in range(420)]
    rows += [(k, 3, [0.5] * 8) for k in range(420, 600)]  # many equal scores
    rows += [(700, 1, None), (800, 2, [None] + [1.0] * 7), (900, 2, [float("inf")] * 8), (1000, 2, [float("nan")] * 8), (1100, 4, [-1.0] * 8), (1200, 5, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{root}/embeddings.parquet")
    return root, own, rows


def test_op11_equals_brute_force(spark, folder):
    df = queries.queries()["op11_alignment"](spark, folder[0])
    assert dict(df.dtypes) == {"doc_id": "bigint", **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint"), "groups_sha256": "string"}
    got = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    want = slow_alignment(folder[1])
    assert len(got) == len(want) and [k for k, w in enumerate(want) if got[k] != w] == []
    assert want[80] == (0,) * 6 + ("",) and want[folder[1].index("a▁b")] == (0,) * 6 + ("",)


def slow_alignment(own):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbol = alignment.byte_symbols()
    found, held = [], Counter()
    for text in own:
        a, b, links, groups = [], [], [], []
        if text:
            raw = (" " + text).encode()
            done = first.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(symbol[c] for c in w)) for i, w in zip(done.ids, done.tokens, strict=True)]
            b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
            if not b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                a, b = [], []
            spans = []
            for tokens in (a, b):
                at, out = 0, []
                for i, x in tokens:
                    out.append((at, at + len(x), i))
                    at += len(x)
                spans.append(out)
            links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
            last = 0
            for cut in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
                groups.append("|".join(",".join(str(i) for s, e, i in own if last < e <= cut) for own in spans))
                last = cut
        found.append((len(a), len(b), len(groups), links, groups))
        held.update(set(links))
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(na, nb, ng, len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, ng, x, g in found]


def test_counts_joined_by_pair_equal_broadcast_ones(spark, folder, monkeypatch):
    from shockwell.llm import hot

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    one, pairs = alignment.align_tokenizers(docs)
    monkeypatch.setattr(hot, "LEAST_HOT", 5)
    other, same = alignment.align_tokenizers(docs, most_broadcast=0)
    assert sorted(one.collect()) == sorted(other.collect()) and sorted(pairs.collect()) == sorted(same.collect())


def test_groups_cover_all_tokens(spark, folder):
    rows = alignment.align_tokenizers(spark.read.parquet(f"{folder[0]}/documents.parquet"), keep_groups=True)[0].collect()
    for r in rows:
        groups = [(list(g["a"]), list(g["b"])) for g in r["groups"]]
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        assert len(groups) == r["n_groups"] and sum(len(g[0]) for g in groups) == r["n_a"] and sum(len(g[1]) for g in groups) == r["n_b"]
        assert r["groups_sha256"] == (hashlib.sha256(written.encode()).hexdigest() if groups else "")


def test_union_find_finds_components():
    r = np.random.default_rng(1)
    for n in (1, 5, 60):
        a, b = r.integers(0, n, (2, n // 2))
        root = list(range(n))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            low, high = sorted((root[x], root[y]))
            root = [low if v == high else v for v in root]
        assert alignment.union_find(n, a, b).tolist() == root


def test_op11_odd_input(spark, odd_docs, no_docs):
    rows = alignment.align_tokenizers(odd_docs)[0].collect()
    assert len(rows) == odd_docs.count()
    assert sorted(tuple(r)[1:] for r in rows) == sorted(slow_alignment([r["text"] for r in odd_docs.collect()]))
    done, pairs = alignment.align_tokenizers(no_docs)
    assert done.count() == 0 and pairs.count() == 0


def slow_negatives(rows, anchors, k=5, n=10):
    usable = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in usable:
        if not anchors(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, other, w in usable if j != i and len(w) == len(v))
        for p, j in [(-s, j) for s, j, other in scored if other == lab][:k]:
            inside = [(j2, -s) for s, j2, other in scored if other != lab and 30 * p <= -100 * s <= 90 * p][:n]
            out += [(i, j, rank, j2, p, s) for rank, (j2, s) in enumerate(inside, 1)]
    return sorted(out)


def test_op12_equals_brute_force_and_sql(spark, folder):
    df = queries.queries()["op12_hard_negatives"](spark, folder[0])
    assert dict(df.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    got = sorted(map(tuple, df.collect()))
    single = [(i, None if lab is None else (lab + 1) % 10 if i % 7 == 0 else lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in folder[2]]
    assert got == slow_negatives(single, lambda i: i % 100 == 0)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder[0][7:]}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op12_hard_negatives"]).fetchall())


def test_digits_blocks_and_ties(spark, folder, monkeypatch):
    """Small digits take many passes, small blocks many cells; the answer is the same, also where every score ties."""
    monkeypatch.setattr(negatives, "DIGIT_BITS", 3)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    rows = spark.createDataFrame([(k, k % 3, [1.0, 2.0]) for k in range(90)] + [(500 + k, 1, [1.0, 1.0 + k / 50]) for k in range(40)], "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, negatives.mine_hard_negatives(rows, F.col("vec_id") % 20 == 0, high_percent=100).collect()))
    usable = [tuple(r) for r in rows.collect()]
    want = []
    for i, lab, v in usable:
        if i % 20 == 0:
            scored = sorted((-sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(v, w, strict=True)), j, other) for j, other, w in usable if j != i)
            for p, j in [(-s, j) for s, j, other in scored if other == lab][:5]:
                want += [(i, j, rank, j2, p, -s) for rank, (s, j2) in enumerate([(s, j2) for s, j2, other in scored if other != lab and 30 * p <= -100 * s <= 100 * p][:10], 1)]
    assert got == sorted(want)


def test_op12_odd_input(spark):
    kind = "vec_id long, embedding array<double>, label string, key string, w string, lab string"
    rows = [(0, [1.0, 2.0], "a"), (0, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, [1.0, 1.0], "b"), (2, [1.0, 1.0], "b"), (3, [1.0], "b"), (None, [1.0, 1.0], "b"), (4, [], "b"), (5, [0.5, 0.6], None), (6, None, "b"), (7, [0.1, 0.9], "c")]
    df = spark.createDataFrame([(*r, "k", "w", "l") for r in rows], kind)
    got = sorted(tuple(r)[:4] for r in negatives.mine_hard_negatives(df, F.col("vec_id") == 0).collect())
    assert got == sorted([(0, 1, 1, 2), (0, 1, 2, 2), (0, 1, 3, 7)] * 2)
    assert negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.mine_hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
    with pytest.raises(OverflowError):
        negatives.mine_hard_negatives(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], "vec_id long, embedding array<double>, label int"), F.lit(True)).collect()
    exact = np.array([[2.0**27 + 1, 3.0]])
    assert negatives.inner(exact, exact).tolist() == [[(2**27 + 1) ** 2 + 9]]


def slow_passages(rows, window):
    """rows: (order of the document, text)."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    earliest = {}
    for (doc, _), own in zip(rows, words, strict=True):
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            earliest[key] = min(earliest.get(key, doc), doc)
    out = []
    for (doc, _), own in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(own) - window + 1) if earliest[tuple(own[k : k + window])] < doc for j in range(window)}
        out.append((len(own), len(gone), b" ".join(w for k, w in enumerate(own) if k not in gone).decode()))
    return out


def test_op13_equals_brute_force_and_sql(spark, folder):
    df = queries.queries()["op13_passages"](spark, folder[0])
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    got = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    want = slow_passages(list(enumerate(folder[1])), 13)
    assert got == {k: (n, lost, hashlib.sha256(kept.encode()).hexdigest()) for k, (n, lost, kept) in enumerate(want)}
    assert sum(lost for _, lost, _ in want) > 500
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder[0][7:]}/documents.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in con.execute(queries.oracle_sql()["op13_passages"]).fetchall()}


@pytest.mark.parametrize("window", [4, 7, 30])
def test_windows_of_other_sizes_in_small_pieces(spark, folder, monkeypatch, window):
    """Texts cut into small pieces, and anchors that count as frequent, give the same."""
    work = [passages._runs(window), passages._halves(window), passages._without(window)]
    assert work and passages.levels(window)[2] == window
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in passages.remove_passages(spark.read.parquet(f"{folder[0]}/documents.parquet"), window).collect()}
    assert got == dict(enumerate(slow_passages(list(enumerate(folder[1])), window)))


def test_stretches_keep_every_window(monkeypatch):
    monkeypatch.setattr(passages, "PIECE_BYTES", 10)
    monkeypatch.setattr(passages, "WORDS", 7)
    own = ["a bb ccc dd e f " * 4, "one", None, "x y z w v"]
    seen = sorted((o, f + k, tuple(p[k : k + 4])) for owner, first, parts in passages._stretches([0, 1, 2, 3], own, 4) for o, f, p in zip(owner, first, parts, strict=True) for k in range(len(p) - 3))
    assert seen == sorted((d, k, tuple(w[k : k + 4])) for d, w in enumerate((t or "").encode().split() for t in own) for k in range(len(w) - 3))


def test_frequent_anchors_are_dealt_apart(spark, folder, monkeypatch):
    monkeypatch.setattr(passages, "SAMPLED", 1)
    monkeypatch.setattr(passages, "LEAST_SEEN", 2)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in passages.remove_passages(spark.read.parquet(f"{folder[0]}/documents.parquet")).collect()}
    assert got == dict(enumerate(slow_passages(list(enumerate(folder[1])), 13)))


def test_op13_odd_input(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_text"]) for r in passages.remove_passages(odd_docs, 5).collect())
    order = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in rows})
    want = slow_passages([(order.index((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")), r["text"]) for r in rows], 5)
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0, *w) for r, w in zip(rows, want, strict=True))
    assert passages.remove_passages(no_docs).count() == 0
    with pytest.raises(ValueError):
        passages.remove_passages(odd_docs, 3)
