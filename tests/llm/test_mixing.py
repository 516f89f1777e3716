from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from namewright.llm import mixing

WEIGHTS = (3, 1, 2)


def brute_targets(sizes):
    """Sources' targets by dealing the total again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    cap = {s: 2.0 * sizes[s] for s in order}
    target, full = {}, set()
    total = 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(cap[s] for s in full)
        target = {s: cap[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > cap[s]}
        if not above:
            return target
        full |= above


def check(spark, docs):
    got = mixing.mix(docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, size(r.text)) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        if want[r.source] >= sizes[r.source]:
            assert r.taken >= r.size  # complete epochs come first
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    again = mixing.mix(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_the_tables(spark, sf_dir):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_edges_of_the_input(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "w " * 5000, "b"), (4, "x y z", None), (4, "x y z", None), (None, "p q", "Z"), (6, "  \x1c", "é"), (7, " ", "empty")]
    check(spark, spark.createDataFrame([(*r, 9, 0.5) for r in rows], "doc_id long, text string, source string, size int, target double"))


def test_one_source_with_most_rows(spark):
    rows = [(i, "w " * (i % 50), "hot" if i % 3 else f"s{i % 40}") for i in range(3000)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_higher_quality_is_taken_more(spark):
    rows = [(i, "one two three", "s" if i < 2000 else f"t{i}", 4.0 if i % 2 else 1.0) for i in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    part = [r for r in mixing.mix(docs, quality="q", share=0.5).collect() if r.source == "s"]
    high, low = (sum(r.taken for r in part if r.doc_id % 2 == odd) for odd in (1, 0))
    assert high > 1.5 * low > 0


def test_odd_weights_and_null_ids_fall_into_many_slices(spark):
    rows = [(None if i % 2 else i, f"one two {i}", "s", [None, 0.0, -1.0, float("nan"), 1e-3, 1.0][i % 6]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mixing.mix(docs, quality="q", share=0.5).collect()
    assert len(got) == 1200 and sum(r.taken for r in got) == 1800
    assert sum(r.taken for r in got if r.doc_id is None) > 0


def test_the_query_weighs_by_the_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = mixing.weighed(docs, mixing.fitted(docs, labels))
    assert scored.agg({mixing.WEIGHT: "max"}).first()[0] > 2 * scored.agg({mixing.WEIGHT: "min"}).first()[0]
    want = mixing.mix(scored, mixing.WEIGHT).select("doc_id", "size", "source_size", "target", "taken")
    assert Counter(map(tuple, mixing.op10_mix(spark, sf_dir).collect())) == Counter(map(tuple, want.collect()))


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
