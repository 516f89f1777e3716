from __future__ import annotations

import random
import re

from namewright.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window=10):
    own = brute_words(text)
    hit, found = [False] * len(own), set()
    for item, t in items:
        ws = brute_words(t)
        if item is None or not ws:
            continue
        n = min(window, len(ws))
        windows = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                found.add(item)
                hit[i : i + n] = [True] * n
    return len(own), sum(hit), sorted(found)


def check(spark, docs, items, **more):
    df = spark.createDataFrame([(i, t, "a", 5) for i, t in docs], "doc_id long, text string, hits string, n_words int")
    bench = spark.createDataFrame([(i, t, "b") for i, t in items], "item_id long, text string, lang string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in d.contamination(df, bench, **more).collect()), key=str)
    want = sorted(((i, *(b := brute(t, items)), b[1] > 0) for i, t in docs), key=str)
    assert got == want


def test_against_brute_force_on_the_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    check(spark, docs, items)


def test_small_alphabets_and_short_items(spark):
    rng = random.Random(2)
    for round_ in range(12):
        letters = "abc"[: 2 + round_ % 2]
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 14] if round_ % 3 else [3, 9, 10, 13])))) for i in range(6)]
        docs = [(i, " ".join(rng.choice(letters + "x" * (round_ % 4)) for _ in range(rng.randrange(60)))) for i in range(25)]
        for i, t in docs:
            a = d.ItemAutomaton([(k, d.words(w)) for k, w in items])
            n, spans, found = a.scan(t)
            assert (n, sum(y - x for x, y in spans), sorted(found)) == brute(t, items)


def test_edges_of_the_input(spark):
    items = [(1, None), (2, ""), (3, "one two three four five six seven eight nine ten eleven"), (None, "alpha beta"), (4, "Über straße ünd"), (5, "tie tie tie")]
    docs = [(1, None), (2, ""), (3, "x One, TWO three-four five six seven eight nine TEN y"), (3, "x One, TWO three-four five six seven eight nine TEN y"), (None, "tie tie tie tie"), (7, "alpha beta"), (8, "Über STRAßE ünd"), (9, "w " * 50_000 + "two three four five six seven eight nine ten eleven")]
    check(spark, docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit) for r in d.contamination(one, bench).collect()] == [(2, 0)]


def test_shards_find_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = {r.doc_id: r.hits for r in d.scan(docs, bench).select("doc_id", "hits").collect()}
    parts = {r.doc_id: r.hits for r in d.scan(docs, bench, shard_chars=4000).select("doc_id", "hits").collect()}
    assert whole == parts
    assert any(h["spans"] for h in whole.values())


def test_clashing_columns(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "x", item, 7, 8, 9)], "doc_id long, hits string, text string, hits_0 int, c0 int, changed int")
    bench = spark.createDataFrame([(1, item), (2, "else " * 30)], "item_id long, text string")
    for size in (4_000_000, 20):
        found = d.scan(docs, bench, shard_chars=size)
        assert found.columns == ["doc_id", "text", "hits_0", "c0", "changed", "hits"]
        (row,) = found.collect()
        assert (row.hits_0, row.c0, row.changed, [tuple(s) for s in row.hits.spans]) == (7, 8, 9, [(0, 11)])
        cleaned = d.remove_spans(docs, bench, shard_chars=size)
        assert cleaned.columns == docs.columns and [tuple(r) for r in cleaned.collect()] == [(1, "x", "", 7, 8, 9)]


def test_removed_spans(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"keep this, {item}. And that", 3), (2, item, 3), (3, "clean Text", 10), (4, None, None)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in d.remove_spans(docs, bench).collect()}
    assert got == {1: ("keep this, . And that", 21), 2: ("", 0), 3: ("clean Text", 10), 4: (None, None)}


def test_what_a_cut_brings_together_is_scanned_again(spark):
    one = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10"
    docs = spark.createDataFrame([(1, f"x b1 b2 b3 b4 b5 {one} b6 b7 b8 b9 b10 y")], "doc_id long, text string")
    two = "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10"
    for items in ([(1, one), (2, two)], [(2, one), (1, two)], [(7, two), (8, one)]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        for size in (4_000_000, 40, 12):
            (row,) = d.remove_spans(docs, bench, shard_chars=size).collect()
            assert row.text.split() == ["x", "y"]


def removed(spark, docs, items, **more):
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.text, r.n_chars) for r in d.remove_spans(df, bench, **more).collect())


def test_shards_remove_the_same(spark):
    """Passages inside passages, spans that only all shards together make long or cover half of a text."""
    rng = random.Random(4)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(rng.choice([3, 5, 9, 10, 14])))) for i in range(24)]
    docs = []
    for n in range(60):
        words = [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(items)[1].split()
        docs.append((n, " ".join(words)))
    for more in ({}, {"max_words": 12}):
        whole = removed(spark, docs, items, **more)
        assert removed(spark, docs, items, shard_chars=250, **more) == whole
        assert any(t != dict(docs)[i] for i, t, _ in whole)


def test_whole_short_items_are_removed(spark):
    items = [(1, "alpha beta gamma"), (2, "nine words one two three four five six seven"), (3, "solo"), (4, " ".join(f"long{i}" for i in range(12)))]
    around = " ".join(f"x{i}" for i in range(40))
    docs = [(i, f"{around} {t} {around}") for i, t in items] + [(5, f"{around} alpha beta {around} long0 long1 long2")]
    for more in ({}, {"shard_chars": 60}):
        got = {i: t.split() for i, t, _ in removed(spark, docs, items, **more)}
        assert all(got[i] == around.split() * 2 for i in range(1, 5))
        assert got[5] == docs[-1][1].split()
