from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import xxhash

from namewright.llm import simhash
from namewright.llm.components import components


def brute_fingerprint(text):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_classes(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            for x in (a, b):
                if label[x] != m:
                    label[x], changed = m, True
    return label


def check_rows(rows, got):
    ids = [i for i, _ in rows]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    edges = [(a, b) for a, b in combinations(ids, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    label = brute_classes(ids, edges)
    assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == sorted((i, fps[i], label[i]) for i in ids)


def test_golay_keys_lose_no_close_pair():
    rng = np.random.default_rng(1)
    for distance in range(4):
        one = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        other = one.copy()
        for i in range(len(one)):
            for b in rng.choice(64, distance, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        keys = []
        for fps in (one, other):
            sets = [set() for _ in fps]
            for place, key in zip(*simhash.fuzzy_keys(fps), strict=True):
                sets[place].add(int(key))
            keys.append(sets)
        assert all(a & b for a, b in zip(*keys, strict=True))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5), (300, 299), (299, 300), (-4, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, -4: -4, 299: -4, 300: -4}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_rows(rows, simhash.simhash_components(docs).collect())


def test_edges_of_the_input(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(1000)}" for _ in range(400)]
    rows = [(50, None), (51, ""), (52, " \t\n"), (53, "one"), (54, "One"), (55, "two words"), (56, "É é"), (57, "x" * 100_000)]
    for i in range(40):
        words = list(base)
        words[rng.randrange(400)] = f"new{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    check_rows(rows, simhash.simhash_components(docs).collect())


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "same text here now"), (4, "same text here now"), (4, "same text here now"), (None, "alone with other words")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.simhash_components(docs).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_blocks_of_a_large_key_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 62, (150, 3))}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in components(simhash.hamming_links(df)).collect()}
    edges = [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    label = brute_classes(fps, edges)
    assert {f: got.get(f, f) for f in fps} == label


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
