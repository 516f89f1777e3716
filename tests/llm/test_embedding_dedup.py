from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

from namewright.llm import embedding_dedup as e


def brute(rows, limit=0.98):
    unit = [e.normal(v) if label is not None else None for _, v, label in rows]
    n, label = len(rows), list(range(len(rows)))
    links = [0] * n

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit:
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    least = {}
    for i in range(n):
        own = [x for x in (least.get(root(i)), rows[i][0]) if x is not None]
        least[root(i)] = min(own, default=None)
    return Counter((rows[i][0], links[i], least[root(i)]) for i in range(n))


def run(spark, rows):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, n_links int, id string")
    got = e.near_vectors(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None and r.component_id is not None)
    return Counter((r.vec_id, r.n_links, r.component_id) for r in got)


def clusters(seed, n=300, width=16, spread=0.03):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    picks = rng.integers(0, 12, n) * (rng.random(n) < 0.6)
    x = centres[picks] + spread * np.linalg.norm(centres[0]) * rng.normal(size=(n, width))
    return [(i, np.float32(v).tolist(), int(i % 3)) for i, v in enumerate(x)]


def test_recall_and_precision_against_brute_force(spark):
    rows = clusters(1)
    got, want = run(spark, rows), brute(rows)
    true, links = {i: n for i, n, _ in want}, {i: n for i, n, _ in got}
    assert all(links[i] <= true[i] for i in true)  # nothing below the limit
    assert sum(links.values()) >= 0.97 * sum(true.values()) > 1000


def test_recall_on_the_tables(spark):
    path = "/root/testdata/check_s/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("the larger table is not here")
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(path).where("label = 1").collect()]
    x = np.stack([e.normal(v) for _, v, _ in rows])
    close = (x @ x.T >= 0.98).sum() - len(rows)
    got = run(spark, rows)
    assert 0.99 * close <= sum(n * k for (_, n, _), k in got.items()) <= close


def test_edges_of_the_input(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2 * a for a in v], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0] * 4, 1), (9, [1.0, None, 2.0, 3.0], 1), (10, [float("nan")] * 4, 1), (11, [float("inf"), 1.0, 1.0, 1.0], 1), (None, v, 1), (12, [1.0], 1), (13, [3.0], 1), (14, [-1e-30, 0.0, 0.0, 0.0], 1), (15, [-1e30, 0.0, 0.0, 0.0], 1), (8, [0.0] * 4, 1)]
    assert run(spark, rows) == brute(rows)


def test_labels_of_other_types(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None)]
    for kind, of in (("string", str), ("long", int), ("short", int)):
        df = spark.createDataFrame([(i, x, None if label is None else of(label)) for i, x, label in rows], f"vec_id long, embedding array<double>, label {kind}")
        assert {(r.vec_id, r.n_links, r.component_id) for r in e.near_vectors(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)}


def test_blocks_of_a_large_bucket_find_the_same(spark, monkeypatch):
    rows = clusters(2, n=400)
    whole = run(spark, rows)
    monkeypatch.setattr(e, "BLOCK", 8)
    assert run(spark, rows) == whole


def test_empty_table(spark):
    assert sum(run(spark, []).values()) == 0
