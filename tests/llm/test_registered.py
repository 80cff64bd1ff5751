"""The registered queries over a small folder of tables, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from shockwell.llm import hot, queries, shards, toxicity, words
from shockwell.llm.components import connected_components

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, n_lines string, toxicity_score string, first string, row string"


def corpus():
    r = random.Random(11)
    pool = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    line, passage = text(14), text(24)
    out = [text(r.randint(1, 120)) for _ in range(120)]
    for k in range(0, 40, 4):
        out[k] += " " + r.choice(["moronic", "idiotic"])
    for k in range(1, 31, 3):
        out[k] += "\n" + line.upper() + "\t\n" + text(5)
    for k in range(2, 12, 4):
        out[k] = out[k] + " " + passage + " " + text(9)
    out += [None, "", " \n\t", "\n\n", "é" * 150, "ab " * 6000, out[50], out[50], out[50] + " x", "Ünïcode 中文 text here " * 30]
    return out, passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts, passage = corpus()
    root = f"file://{tmp_path_factory.mktemp('tables')}"
    rows = [(k, t, "en", "s", len(t or ""), "kept", "n", "t", "f", "r") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, EXTRA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), int(bool(t) and ("moronic" in t or "idiotic" in t))) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("b1", passage), ("b2", "ab ab"), ("b3", None), ("b4", "")], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    draw = np.random.default_rng(5)
    base = draw.normal(size=(12, 16))
    vectors = [(k, f"l{k % 3}" if k % 11 else None, (base[k % 6] + 0.08 * draw.normal(size=16)).tolist()) for k in range(150)] + [(150, "l0", [0.0] * 16), (151, "l0", None), (152, "l0", [float("nan")] + [1.0] * 15), (153, "l1", base[1].tolist()), (154, "l1", base[1].tolist())]
    spark.createDataFrame(vectors, "vec_id long, label string, embedding array<double>").write.parquet(f"{root}/embeddings.parquet")
    return root, texts, vectors


def rows_of(spark, folder, name):
    df = queries.queries()[name](spark, folder[0])
    rows = {}
    for r in df.collect():
        rows.setdefault(r[0], []).append(r)
    return df, rows


def raw(text):
    return (text or "").encode()


def test_op1(spark, folder):
    df, rows = rows_of(spark, folder, "op1_sharding")
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert {k: (r[0].size, r[0].text_crc32, r[0].law, r[0].grown_shard) for k, r in rows.items()} == {k: (len(raw(t)) + 1, zlib.crc32(raw(t)), "rows", None) for k, t in enumerate(folder[1])}
    slots = [sorted(r[0].slot for r in rows.values() if r[0].shard == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def groups_of(n, near):
    root = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if near(i, j) and root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    return root


def test_op2(spark, folder):
    _, rows = rows_of(spark, folder, "op2_embedding_groups")
    vectors = folder[2]
    sound = lambda v: v is not None and all(math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.linalg.norm(v) if sound(v) else None for _, _, v in vectors]
    near = lambda i, j: i != j and unit[i] is not None and unit[j] is not None and vectors[i][1] is not None and vectors[i][1] == vectors[j][1] and float(unit[i] @ unit[j]) >= 0.93
    root = groups_of(len(vectors), near)
    for i in range(len(vectors)):
        assert (rows[i][0].n_links, rows[i][0].component_id, rows[i][0].kept) == (sum(near(i, j) for j in range(len(vectors))), root[i], root[i] == i)


def slow_print(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    grams = [" ".join(tokens[k : k + 4]) for k in range(max(1, len(tokens) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3(spark, folder):
    _, rows = rows_of(spark, folder, "op3_simhash")
    prints = [slow_print(t) for t in folder[1]]
    root = groups_of(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert {k: (r[0].fingerprint, r[0].component_id) for k, r in rows.items()} == {k: (f"{p:016x}", root[k]) for k, p in enumerate(prints)}


@pytest.mark.parametrize(("name", "folds", "held", "bar"), [("op4_quality", 4, 2, 0.7), ("op10_toxicity", 5, 0, 0.5)])
def test_scores(spark, folder, name, folds, held, bar):
    df, rows = rows_of(spark, folder, name)
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} and len(rows) == len(folder[1])
    for k, (r,) in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= bar)


@pytest.mark.parametrize(("name", "tables"), [("op5_decontamination", "documents benchmark"), ("op9_shared_lines", "documents")])
def test_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder[0][7:]}/{t}.parquet/*.parquet')")
    df = queries.queries()[name](spark, folder[0])
    got = df.toPandas().sort_values("doc_id").reset_index(drop=True).astype(str)
    want = con.execute(queries.oracle_sql()[name]).df()[list(got.columns)].sort_values("doc_id").reset_index(drop=True).astype(str)
    assert (got == want).all().all() and (df.where("contaminated").count() if name.startswith("op5") else df.where("n_dropped > 0").count()) > 0


def test_op6(spark, folder):
    _, rows = rows_of(spark, folder, "op6_repeats")
    seen = set()
    for k, t in enumerate(folder[1]):
        data, gone = raw(t), np.zeros(len(raw(t)), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        r = rows[k][0]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


@pytest.fixture(scope="module")
def encode():
    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    code.encode_special_tokens = True
    return lambda t: code.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op7(spark, folder, encode):
    df, rows = rows_of(spark, folder, "op7_packing")
    for k, t in enumerate(folder[1]):
        ids, at = [*encode(t), 1], 0
        for r in sorted(rows[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    packs = {}
    for r in df.collect():
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in packs.values():
        assert [o for o, _ in sorted(spans)] == list(np.cumsum([0] + [n for _, n in sorted(spans)])[:-1]) and sum(n for _, n in spans) <= 2048
    assert sorted(packs) == list(range(len(packs))) and len(packs) <= 1.2 * sum(n for s in packs.values() for _, n in s) / 2048 + 1


def test_op8(spark, folder, encode):
    _, rows = rows_of(spark, folder, "op8_token_files")
    start = 0
    for k, t in enumerate(folder[1]):
        ids = [*encode(t), 0]
        assert (rows[k][0].start, rows[k][0].n_tokens, rows[k][0].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_the_string_kernel_is_that_of_brute_force():
    def slow(word):
        s, out = "\x01" + word + "\x02", {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + toxicity.DECAY ** (k - i - 2)
        return out

    def kernel(a, b):
        dot = lambda x, y: sum(v * y.get(g, 0) for g, v in x.items())
        return dot(slow(a), slow(b)) / math.sqrt(dot(slow(a), slow(a)) * dot(slow(b), slow(b)))

    some, marks = ["moron", "mxoron", "идиот", "идинот", "glücklich", "ab", "窓"], ["moron", "идиот", "ab"]
    got = toxicity.Landmarks(marks).kernel(some)
    assert np.allclose(got, [[kernel(a, b) for b in marks] for a in some], atol=1e-5)


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(words, "string_hashes", lambda data, start, end: (end - start).astype(np.uint64))  # all of a length collide
    data = np.frombuffer(b"aa bb aa ccc bb dd", np.uint8)
    start, end = np.array([0, 3, 6, 9, 13, 16]), np.array([2, 5, 8, 12, 15, 18])
    each, where, inverse = words.distinct(data, start, end)
    text = [bytes(data[start[w] : end[w]]) for w in where]
    assert sorted(text) == [b"aa", b"bb", b"ccc", b"dd"] and [text[i] for i in inverse] == [b"aa", b"bb", b"aa", b"ccc", b"bb", b"dd"]
    memory = words.Memory(10, 100)
    memory.add(data, start[where], end[where], each, np.arange(len(where)))
    found = memory.find(data, start, end, (end - start).astype(np.uint64))
    assert all(n < 0 or text[n] == bytes(data[a:b]) for n, a, b in zip(found, start, end, strict=True)) and (found >= 0).any()


def test_large_hypergeometric_draws():
    draw = np.random.Generator(np.random.PCG64(1))
    got = np.bincount([shards._large_hypergeometric(draw, 50, 70, 30) for _ in range(20000)], minlength=31)
    pmf = np.array([math.comb(50, k) * math.comb(70, 30 - k) / math.comb(120, 30) for k in range(31)])
    ok = pmf * 20000 > 5
    assert ((got - pmf * 20000)[ok] ** 2 / (pmf * 20000)[ok]).sum() < 45  # about 18 degrees of freedom
    matrix = shards.communication_matrix([10**8] * 1000, 8, 3)
    assert (matrix.sum(axis=1) == 10**8).all() and set(matrix.sum(axis=0)) == {125 * 10**8}
    chi = ((matrix - 125e5) ** 2 / 125e5).sum(axis=1)
    assert 6 < chi.mean() < 8 and 10 < chi.var() < 19


def test_rows_with_maps_are_shuffled(spark):
    rows = spark.createDataFrame([(k, {"a": k}) for k in range(50)], "doc_id long, m map<string,long>")
    assert sorted(r.m["a"] for r in shards.shuffle_to_shards(rows, 4).collect()) == list(range(50))


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST_HOT", 5)
    many = spark.createDataFrame([(1, k) for k in range(100)] + [(k, k) for k in range(2, 40)], "u long, v long")
    one = many.groupBy("u").count().withColumnRenamed("count", "n").withColumn("m", -many.u)
    got = hot.join_hot(many, one.select("u", "m", "n"), "u", "n", many.count())
    assert got.columns == ["u", "v", "m"] and sorted(map(tuple, got.collect())) == sorted((r.u, r.v, -r.u) for r in many.collect())
    star = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(70, 71)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(star).collect()} == {**{k: 0 for k in range(60)}, 70: 70, 71: 70}


def test_pipeline_keeps_rows_and_columns_apart(spark, folder):
    """Repeated and null ids, columns that operators use themselves, and an empty table."""
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"u{k}" for k in range(60))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (None, b, "x"), (None, None, "x"), (7, None, "x"), (2, b, "x")]
    table = spark.createDataFrame([(i, t, "en", "s", 0, z, z, z, z, z) for i, t, z in rows], EXTRA)
    kept = corpus_pipeline.near_duplicates(spark, table, folder[0]).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, a), (2, b), (7, "")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (table, table.limit(0)):
            out = stage(spark, docs, folder[0])
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
            assert all(r.kept_text == r.n_lines == r.toxicity_score == r.first == r.row == "x" for r in out.collect()), name


def test_components_of_many_chunks(spark, monkeypatch):
    from shockwell.llm import components

    monkeypatch.setattr(components, "CHUNK", 7)
    r = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(r.randint(50, 150), r.randint(50, 150)) for _ in range(60)] + [(200, 200), (None, 3)]
    root = list(range(201))
    for a, b in edges:
        if a is not None:
            x, y = sorted((root[a], root[b]))
            root = [x if z == y else z for z in root]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()}
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {k: root[k] for k in touched}
