"""Every operator on odd rows and on none, and against brute-force versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockwell.llm import fmindex, mph, neighbours, packing, quality, repeats, simhash, tokens, toxicity
from shockwell.llm.decontaminate import WORD, decontaminate, find_contamination, lower_ascii
from shockwell.llm.lines import drop_shared_lines
from shockwell.llm.shards import communication_matrix, shuffle_to_shards
from shockwell.llm.suffixes import SuffixArray
from shockwell.llm.tokenfiles import lookup, read_token_files, write_token_files


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# 1: sharding


def test_shards_are_exact(spark, odd_docs, no_docs):
    got = shuffle_to_shards(odd_docs, 4, rows_per_partition=4)
    assert rows_of(got, "doc_id", "text") == rows_of(odd_docs, "doc_id", "text")
    slots = {}
    for r in got.select("shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3] and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shuffle_to_shards(no_docs, 4).count() == 0


def test_shards_are_uniform():
    matrix = communication_matrix([100, 0, 37, 63], 8, 5)
    assert matrix.sum(axis=1).tolist() == [100, 0, 37, 63] and matrix.sum(axis=0).tolist() == [25] * 8


# 2: embeddings


def test_neighbour_groups_are_those_of_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((150, 16))
    x = np.concatenate([base, base[:40] + 0.12 * r.standard_normal((40, 16)), np.repeat(base[:1], 30, 0), base[1] + 0.05 * r.standard_normal((60, 16))]).astype(np.float32)
    label = [int(k % 3 == 0) for k in range(len(x))]
    rows = [(k, v.tolist(), b) for k, (v, b) in enumerate(zip(x, label, strict=True))]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, x[0].tolist(), None), (1004, [None] + [1.0] * 15, 1), (1005, [], 1), (1006, [1.0], 1), (None, x[0].tolist(), 0)]
    got, audit = neighbours.near_duplicate_groups(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    group = list(range(len(x)))
    for _ in group:
        group = [min([group[k], *(group[j] for j in np.flatnonzero(near[k]))]) for k in range(len(x))]
    want = [(k, int(near[k].sum()), group[k], group[k] == k) for k in range(len(x))]
    found = {r[0]: tuple(r) for r in got.collect()}
    assert [found[k] for k in range(len(x))] == want and audit.recall == 1.0
    assert all(found[k][1:] == (0, k, True) for k in range(1000, 1007)) and found[None][1] == 0


def test_no_vectors(spark):
    assert neighbours.near_duplicate_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))[0].count() == 0


# 3: SimHash


def slow_fingerprint(text):
    import xxhash

    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    words = [w.encode().lower().decode() for w in words]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(odd_docs):
    for r in odd_docs.select("text").collect()[:48]:
        assert simhash.fingerprint(r.text) == slow_fingerprint(r.text)


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_links_span_all_close_pairs(spark, most):
    r = random.Random(1)
    seeds = [r.getrandbits(64) for _ in range(30)]
    prints = {*seeds, *(s ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for s in seeds for _ in range(8))}
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    edges = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.fingerprint_links(nodes, 4, 7, most).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)

    def groups(pairs):
        root = {p: p for p in prints}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(q for q in prints if find(q) == find(p)) for p in prints}

    every = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    assert groups(edges) == groups(every)


def test_simhash_rows(odd_docs, no_docs):
    got = simhash.simhash_groups(odd_docs)
    assert got.count() == odd_docs.count() and simhash.simhash_groups(no_docs).count() == 0
    by = {r.doc_id: r.component_id for r in got.collect()}
    assert by[45] == by[46] == by[0] == 0 and by[40] == by[41] == 40


# 4 and 10: classifiers


def classified(spark, make, n=600):
    r = random.Random(8)
    rows = [(k, *make(r)) for k in range(n)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, y) for k, _, y in rows] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {k: y for k, _, y in rows}


def test_quality_on_held_out_rows(spark, odd_docs, no_docs):
    def make(r):
        good = r.random() < 0.7
        words = ["alpha", "beta", "gamma", "delta", "river", "stone"]
        text = ". ".join(" ".join(r.choice(words) for _ in range(8)).capitalize() for _ in range(6)) + "."
        return (text if good else "!!!".join(r.choice(words).upper() for _ in range(20))), int(good)

    docs, labels, truth = classified(spark, make)
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality.score_quality(docs, model).collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.7) == bool(truth[k]) for k in held]) > 0.97
    assert quality.score_quality(odd_docs, model).where("quality_score between 0 and 1").count() == odd_docs.count()
    assert quality.score_quality(no_docs, model).count() == 0
    assert quality.score_quality(docs, quality.fit_quality(docs, labels.where("quality = 1"))).where("quality_score = 0.7").count() == docs.count()


def test_toxicity_tolerates_gaps(spark, odd_docs, no_docs):
    words = ["river", "stone", "garden", "window", "letter", "morning", "idea", "station", "local"]

    def make(r):
        bad = r.random() < 0.3
        text = [r.choice(words) for _ in range(20)]
        if bad:
            text[r.randrange(20)] = r.choice(["idiot", "scumbag", "idiots", "ixdiot", "scumxbag"])
        return " ".join(text), int(bad)

    docs, labels, truth = classified(spark, make)
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r.toxicity_score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == bool(truth[k]) for k in held]) > 0.97
    said = toxicity.Scorer(model).scores(["you idqiot of a river", "you i-d-i-o-t there", "a morning letter", None, ""])
    assert said[0] > 0.5 and said[1] > 0.5 and (said[2:] < 0.5).all()
    assert toxicity.score_toxicity(odd_docs, model).count() == odd_docs.count() and toxicity.score_toxicity(no_docs, model).count() == 0


# 5: decontamination


def test_fm_index_finds_all_places():
    r = np.random.default_rng(2)
    runs = [r.integers(1, 4, r.integers(1, 40)) for _ in range(12)]
    text = np.concatenate([np.append(x, 0) for x in runs])
    index = fmindex.FMIndex(text)
    for size in (1, 2, 4):
        phrases = r.integers(1, 5, (25, size))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(len(text) - size + 1) if (text[k : k + size] == p).all()]


@pytest.mark.parametrize("limits", [{}, {"shard_words": 5, "pass_bytes": 300}])
def test_contamination_is_that_of_brute_force(spark, odd_docs, no_docs, limits):
    r = random.Random(5)
    words = ["a", "b", "c", "dé"]
    items = [(f"i{k}", " ".join(r.choice(words) for _ in range(r.randint(1, 14)))) for k in range(20)] + [("none", None), ("i0", "b c zz"), ("empty", "")]
    docs = [(k, " , ".join(r.choice(words).upper() for _ in range(r.randint(0, 60)))) for k in range(60)] + [(None, None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, window=5, **limits)
    want = []
    for k, t in docs:
        own = WORD.findall(lower_ascii(t or ""))
        hit, names = set(), set()
        for name, text in items:
            w = WORD.findall(lower_ascii(text or ""))
            n = min(5, len(w))
            for s in range(len(w) - n + 1 if w else 0):
                at = [p for p in range(len(own) - n + 1) if own[p : p + n] == w[s : s + n]]
                hit |= {p + j for p in at for j in range(n)}
                names |= {name} if at else set()
        want.append((k, len(own), sorted(hit), sorted(names)))
    found = [(r.doc_id, r.n_words, [p for a, b in zip(r.starts, r.ends, strict=True) for p in range(a, b)], list(r["items"])) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert decontaminate(odd_docs, bench).columns == odd_docs.columns
    assert decontaminate(odd_docs, bench.limit(0)).exceptAll(odd_docs).count() == 0
    assert find_contamination(no_docs, bench).count() == 0


# 6: repeats


def test_suffix_arrays_show_all_maximal_repeats():
    for t in range(60):
        r = random.Random(t)
        strings = [bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 20))) for _ in range(r.randint(1, 5))]
        text, least = b"".join(strings), r.randint(1, 3)
        array = SuffixArray(np.frombuffer(text, np.uint8), np.array([len(s) for s in strings]))
        seen, base = {}, 0
        for s in strings:
            for i in range(len(s)):
                for j in range(i + least, len(s) + 1):
                    seen.setdefault(s[i:j], []).append((base + i, s[i - 1] if i else None, s[j] if j < len(s) else None))
            base += len(s)
        differ = lambda o, k: None in {x[k] for x in o} or len({x[k] for x in o}) > 1
        want = {(len(w), tuple(sorted(x[0] for x in o))) for w, o in seen.items() if len(o) > 1 and differ(o, 1) and differ(o, 2)}
        assert {(n, tuple(sorted(p.tolist()))) for n, p in array.repeats(least)} == want


@pytest.mark.parametrize("options", [{}, {"least": 20}, {"group_bytes": 300}, {"least": 33, "group_bytes": 500, "array_bytes": 1000}])
def test_repeats_are_those_of_brute_force(spark, odd_docs, no_docs, options):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeéü") for _ in range(r.randint(1, 6))) for _ in range(40)]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(8)]
    rows = [(i, " ".join(r.choice(base)[: r.randint(10, 300)] if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(r.randint(1, 20))) for _ in range(r.randint(0, 4)))) for i in range(60)]
    rows += [(200 + i, rows[3][1]) for i in range(9)] + [(300, "a" * 700), (301, "a" * 2000), (302, "ab" * 600), (303, None), (304, "")]
    least, seen, want = options.get("least", 100), set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            if raw[p : p + least] in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(raw[p : p + least])
        want.append((i, len(raw), sum(gone), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    found = [(r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), hashlib.sha256(r.kept).hexdigest()) for r in got.collect()]
    assert sorted(found) == want
    if not options:
        assert repeats.remove_repeats(odd_docs).count() == odd_docs.count() and repeats.remove_repeats(no_docs).count() == 0


# 7 and 8: tokens


def test_words_have_the_ids_of_whole_texts(monkeypatch, odd_docs):
    code = tokens.Encoder(tokens.default_tokenizer())
    monkeypatch.setattr(tokens, "CHUNK", 300)
    monkeypatch.setattr(tokens, "MOST_WORDS", 500)
    r = random.Random(5)
    texts = ["".join(r.choice(" \n\tab1.,'s é中\r\x1c <|endoftext|>x") for _ in range(r.randint(0, 90))) for _ in range(600)]
    texts += [" ".join(r.choice(["a", "bé", "it's", "12x", "中文", "\nq"]) for _ in range(400)) for _ in range(9)] + [x.text or "" for x in odd_docs.select("text").collect()]
    want = [np.array(x.ids, code.dtype).tobytes() for x in code.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x for k in range(0, len(texts), 50) for x in code.encode(texts[k : k + 50])] == want


def test_packing_places_every_id_once(spark, odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, room=64, keep_ids=True).collect()
    code = tokens.encoder(tokens.default_tokenizer())
    want = Counter((r.doc_id, code.encode([r.text or ""])[0]) for r in odd_docs.select("doc_id", "text").collect())
    assert sum(r.length for r in got) == sum(n * (len(ids) // 2 + 1) for (_, ids), n in want.items())
    sequences = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] <= 64
    assert len(sequences) * 64 < 1.05 * sum(r.length for r in got) + 64
    assert packing.pack_documents(no_docs).count() == 0


def test_token_files_come_back(spark, odd_docs, no_docs, tmp_path):
    write_token_files(odd_docs, f"file://{tmp_path}/t", shard_bytes=500)
    got = read_token_files(spark, f"file://{tmp_path}/t").collect()
    code = tokens.encoder(tokens.default_tokenizer())
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in odd_docs.select("doc_id", "text").collect()))
    start, want = 0, []
    for there, k, _, t in rows:
        ids = np.append(np.frombuffer(code.encode([t])[0], code.dtype), 0).astype("<u4")
        want.append((k if there else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    found = {r.key: r.ids for r in lookup(spark, f"file://{tmp_path}/t", [2, 4, 10**9]).collect()}
    assert sorted(found) == [2, 4] and found[4][-1] == 0
    write_token_files(no_docs, f"file://{tmp_path}/none")
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_perfect_index():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    index = mph.PerfectIndex.load(mph.PerfectIndex.build(keys, np.arange(5000)).dump())
    assert (index.find(keys) == np.arange(5000)).all() and (index.find(keys + 1) == -1).mean() > 0.99


# 9: lines


def test_lines(spark, odd_docs, no_docs):
    r = random.Random(9)
    pool = ["  Line number %d that is surely long enough to count as one\t" % k for k in range(6)] + ["short", "", "LINE number 1 that is surely long enough to count as one"]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(1, 6)))) for k in range(40)] + [(99, None)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = {}
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(k)
    gone = {x: max(h) for x, h in holders.items() if len(h) >= 5}
    want = []
    for k, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (key(x) in gone and gone[key(x)] != k)]
        want.append((k, len(lines), len(lines) - len(stay), None if t is None else "\n".join(stay)))
    got = drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=repr)
    assert drop_shared_lines(odd_docs).count() == odd_docs.count() and drop_shared_lines(no_docs).count() == 0
