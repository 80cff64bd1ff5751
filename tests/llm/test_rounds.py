"""Jobs that near-duplicates take: the driver holds the plan and the tasks of each."""

import random

from shockwell.llm import components, shingles


def counted(monkeypatch, module):
    names = []
    real = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name="table", *a, **b: names.append(name) or real(df, name, *a, **b))
    return names


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already are written once; a long path takes rounds, and ends right."""
    written = counted(monkeypatch, components)
    stars = spark.createDataFrame([(k % 5, 10 + k) for k in range(60)], "src long, dst long").coalesce(1)
    assert {x.node: x.component for x in components.connected_components(stars).collect()} == {**{10 + k: k % 5 for k in range(60)}, **{k: k for k in range(5)}}
    assert written == ["edges"]
    path = [(k, k + 1) for k in range(200)] + [(300, 301), (301, 302), (7, 7)]
    random.Random(1).shuffle(path)
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(path, "src long, dst long").repartition(4)).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 300: 300, 301: 300, 302: 300}
    assert not components.connected_components(stars.limit(0)).collect()


def test_few_turns(spark, monkeypatch):
    """Edited copies in a large group: components are found in three turns at most."""
    written = counted(monkeypatch, shingles)
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    first = [r.choice(words) for _ in range(150)]
    texts = []
    for k in range(80):
        own = list(first)
        for at in r.sample(range(150), k % 3):
            own[at] = r.choice(words)
        texts.append(" ".join(own))
    rows = [(k, t, "en") for k, t in enumerate([*texts, "another text that stands alone here"])]
    got = {x.doc_id: x.component_id for x in shingles.shingle_groups(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {**dict.fromkeys(range(80), 0), 80: 80}
    assert written.count("met") <= 3
