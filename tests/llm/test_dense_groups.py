"""Links between dense groups, which bounded neighbour lists can't hold."""

import numpy as np

from shockwell.llm import neighbours


def test_links_between_dense_groups(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows, truth = [], {}
    for label in range(2):
        # two groups, cosine about 0.985 inside and 0.945 between them; a third one far away
        a = np.eye(64)[0]
        b = 0.955 * a + np.sqrt(1 - 0.955**2) * np.eye(64)[1]
        far = np.eye(64)[2]
        for k, centre in enumerate((a, b, far)):
            x = centre + r.normal(0, 0.008, (60, 64))
            rows += [(1000 * label + 100 * k + n, v.tolist(), label) for n, v in enumerate(x)]
        own = [(i, np.array(v)) for i, v, y in rows if y == label]
        x = np.stack([v / np.linalg.norm(v) for _, v in own])
        near = x @ x.T >= 0.93
        ids = [i for i, _ in own]
        assert near[0, 60:120].any() and not near[:120, 120:].any()
        truth |= {i: (int(near[n].sum()) - 1, 1000 * label + (200 if n >= 120 else 0)) for n, i in enumerate(ids)}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (neighbours.BLOCK, 25):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got, audit = neighbours.near_duplicate_groups(vectors)
        assert {x.vec_id: (x.n_links, x.component_id) for x in got.collect()} == truth and audit.recall == 1


def test_too_little_recall_ends_in_an_exact_comparison(spark, monkeypatch):
    r = np.random.default_rng(6)
    first = r.normal(0, 1, (100, 32))
    x = np.concatenate([first, first + r.normal(0, 0.1, first.shape)])
    unit = neighbours.unit(x)
    near = unit @ unit.T >= 0.93
    monkeypatch.setattr(neighbours, "_neighbours_in_order", lambda batches: iter(()))  # no graph at all
    vectors = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got, audit = neighbours.near_duplicate_groups(vectors)
    assert {x.vec_id: x.n_links for x in got.collect()} == dict(enumerate((near.sum(axis=1) - 1).tolist())) and audit.recall == 1
