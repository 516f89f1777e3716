from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from namewright.llm import mixing, near_text, quality
from namewright.session import cut


def shingles(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {xxhash.xxh64(b" ".join(words[i : i + 5]), seed=42).intdigest() for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    """Least doc_id of each group by all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return list(groups.values())


def copies(rng, base, n):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_dedup_keeps_one_of_each_group(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(300))
    rows += [(10_000 + i, t) for i, t in enumerate(copies(rng, base, 60))] + [(20_000 + i, base) for i in range(30)]
    rows += [(30_000, None), (30_001, ""), (30_002, " \n"), (30_003, "one two"), (30_004, "One  two"), (30_005, "one two three")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h string")
    kept = {r.doc_id for r in near_text.keep_one_of_each_group(docs).collect()}
    groups = brute_groups(rows)
    assert kept == {min(g) for g in groups}


def test_near_dedup_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "another text with words"), (None, "a b c d e f"), (None, "alone here"), (None, "alone here")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in near_text.keep_one_of_each_group(docs).collect())
    assert got == {(1, "a b c d e f"): 1, (1, "another text with words"): 1, (None, "alone here"): 1}
    assert near_text.keep_one_of_each_group(docs.limit(0)).count() == 0


def test_small_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(300))
    docs = spark.createDataFrame(list(enumerate([base, *copies(rng, base, 80)])), "doc_id long, text string")
    whole = {r.doc_id for r in near_text.keep_one_of_each_group(docs).collect()}
    assert 0 in whole and len(whole) <= 3
    monkeypatch.setattr(near_text, "ALL_PAIRS", 4)
    monkeypatch.setattr(near_text, "BLOCK", 8)
    monkeypatch.setattr(near_text, "GROUP_BLOCK", 8)
    assert {r.doc_id for r in near_text.keep_one_of_each_group(docs).collect()} == whole


def test_golay_groups_hold_all_near_fingerprints(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for p in prints for _ in range(3)]
    distinct = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)], "id long, fp long")
    label = list(range(len(prints)))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    want = sorted(sorted(i for i, x in enumerate(label) if x == k) for k, n in Counter(label).items() if n > 1)
    got = {}
    for r in near_text._golay_groups(distinct).collect():
        got.setdefault(r.grp, []).append(r.id)
    assert sorted(map(sorted, got.values())) == want


def isolated_pairs(rng):
    """Texts in pairs at a similarity of 0.80 to 0.85: long ones with changed words, and 8 words that gain one."""
    out = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        other = list(words)
        for at in rng.sample(range(0, 400, 8), 8):
            other[at] = f"x{rng.randrange(10**6)}"
        out += [" ".join(words), " ".join(other)]
        short = [f"s{k}t{i}" for i in range(9)]
        out += [" ".join(short[:8]), " ".join(short)]
    return out


def templated(rng):
    """Texts that share most of a passage: very common shingles, pairs on both sides of the limit."""
    base = [f"b{i}" for i in range(120)]
    out = []
    for _ in range(90):
        words = list(base)
        for at in rng.sample(range(0, 120, 5), rng.choice([1, 2, 3, 4])):
            words[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in near_text.keep_one_of_each_group(docs).collect())


@pytest.mark.parametrize("make", [isolated_pairs, templated])
def test_no_pair_is_lost_at_the_limit(spark, make):
    texts = make(random.Random(11))
    assert kept_of(spark, texts) == sorted(min(g) for g in brute_groups(list(enumerate(texts))))


@pytest.mark.parametrize("make", [isolated_pairs, templated])
def test_the_exact_pass_alone_loses_no_pair(spark, monkeypatch, make):
    """Without candidates of the first pass, every shingle counted, and common ones dealt over blocks."""
    texts = make(random.Random(12))[:240]
    none = spark.createDataFrame([], "id long, grp long")
    for changed in ({"SAMPLE": 1, "BLOCK": 8, "GROUP_BLOCK": 8}, {"SAMPLE": 1, "HOT": 0}):
        with monkeypatch.context() as m:
            m.setattr(near_text, "_golay_groups", lambda distinct: none)
            for name, value in changed.items():
                m.setattr(near_text, name, value)
            assert kept_of(spark, texts) == sorted(min(g) for g in brute_groups(list(enumerate(texts))))


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output on a small table."""
    d = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        after = cut(stage(spark, docs, d), "test-stage")
        out[name] = (docs, after)
        docs = after
    return out


def test_columns(stages):
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_classifier_stage(spark, stages):
    before, after = stages["quality classifier"]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")
    kept = {r.doc_id for r in after.collect()}
    good = [r.doc_id for r in labels.collect()]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert len(kept) < before.count()


def test_decontamination_stage(spark, stages):
    from namewright.llm import decontaminate

    before, after = stages["benchmark decontamination"]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    hits = {r.doc_id: r.n_hit for r in decontaminate.contamination(before, bench).collect()}
    left = {r.doc_id: r.n_hit for r in decontaminate.contamination(after, bench).collect()}
    assert any(hits.values()) and not any(left.values())
    was, now = ({r.doc_id: r.text for r in df.collect()} for df in (before, after))
    assert all(now[i] == was[i] for i, n in hits.items() if not n)


def test_mixing_stage(spark, stages):
    before, after = stages["mixing sources to target weights"]
    first, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    scored = mixing.weighed(before, quality.fitted(first, labels))
    want = {r.doc_id: (r.taken, r.size) for r in mixing.mix(scored, mixing.WEIGHT, whole=True).collect()}
    got = Counter(r.doc_id for r in after.collect())
    assert got == Counter({i: round(t / s) for i, (t, s) in want.items() if t})


def test_run_equals_the_stages(spark, stages):
    got = Counter(map(tuple, cp.run(spark, "/root/testdata/sf0.001").collect()))
    assert got == Counter(map(tuple, stages["token-ID / binary output"][1].collect()))
    assert cp.ORACLE_SQL is None and quality.MAX_TRAINING_ROWS > 0


def test_documents_from_elsewhere(spark, stages, tmp_path):
    """The mix weighs by the classifier of the run's own documents; sf_dir need not have them, or has others."""
    d = "/root/testdata/sf0.001"
    for table in ("labels", "benchmark"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{d}/{table}.parquet")
    want = Counter(r.doc_id for r in stages["mixing sources to target weights"][1].collect())
    for others in (False, True):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        if others:
            docs.limit(5).write.parquet(str(tmp_path / "documents.parquet"))
        for _, stage in cp.STAGES[:4]:
            docs = cut(stage(spark, docs, str(tmp_path)), "test-stage")
        assert Counter(r.doc_id for r in docs.collect()) == want


def test_stages_take_an_empty_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.lit(False))
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
