"""The pipeline's stages on a small corpus with planted cases."""

import random

import pyarrow as pa

import corpus_pipeline
from shockwell.llm import packing
from shockwell.llm.tokens import encoder


def test_pipeline(spark, tmp_path):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    line, passage = text(12), text(15)
    docs = [[k, text(60), "en", "s", 0] for k in range(120)]
    for k in range(0, 60, 3):
        docs[k][1] += " moronic"
    for k in range(1, 13, 2):
        docs[k][1] += "\n" + line
    docs[20][1] += " " + passage
    docs += [[200 + k, docs[22][1], "en", "s", 0] for k in range(3)] + [[300, None, None, None, None], [301, "", "en", "s", 0]]
    root = f"file://{tmp_path}/sf"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(d[0], 1, int("moronic" in (d[1] or ""))) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("b", passage)], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, root)
        assert out.columns == now.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        now = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = {x.doc_id: x.text for x in now.collect()}
    toxic = {d[0] for d in docs if "moronic" in (d[1] or "")}
    assert set(kept["toxicity"]) == {d[0] for d in docs} - toxic
    holders = [k for k, t in kept["toxicity"].items() if line in (t or "")]
    assert [k for k, t in kept["line_dedup"].items() if line in (t or "")] == ([max(holders)] if len(holders) >= 5 else holders)
    assert {22, 200, 201, 202} & set(kept["near_duplicates"]) == {22} and {300, 301} & set(kept["near_duplicates"]) == {300}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) and passage not in kept["decontamination"][20] and kept["near_duplicates"][20].startswith(kept["decontamination"][20][:200])
    assert {x.doc_id for x in corpus_pipeline.STAGES[-1][1](spark, now, root).collect()} == set(kept["decontamination"])


def test_packing_leaves_no_words_behind(monkeypatch):
    """Workers of the last stage keep neither tokenizer nor words for the stages of the next run."""
    asked = {}
    monkeypatch.setattr(corpus_pipeline, "_bounded", lambda spark: None)
    monkeypatch.setattr(corpus_pipeline, "pack_documents", lambda docs, **given: asked.update(given))
    corpus_pipeline.packing(None, None, "")
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["some words", None]})
    make = packing._pieces(packing.default_tokenizer(), 1, 2048, list(packing.PIECE)[:5], asked["most_words"], asked["keep_words"])
    assert sum(x.num_rows for x in make(iter([batch]))) == 2 and encoder.cache_info().currsize == 0
