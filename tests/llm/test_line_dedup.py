from __future__ import annotations

import random
from collections import Counter, defaultdict

from namewright.llm import line_dedup as ld

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    held = defaultdict(set)
    key = lambda x: x.strip(SPACES).translate(LOWER)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 20:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc is None or len(held[key(x)]) < 3 or max(held[key(x)]) == doc]
        out.append((doc, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return Counter(out)


def check(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, h string, n_lines int")
    assert Counter(map(tuple, ld.dedup_lines(df, **more).collect())) == brute(rows)


def test_the_tables(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_edges_of_the_input(spark):
    rng = random.Random(1)
    pool = [f"a line that stands in many documents {i}" for i in range(12)] + ["short", "", "  A Line THAT stands in many documents 3\t", "É" * 20, "é" * 20, "x" * 19, "x" * 20, "\x0b" + "x" * 20 + "\r"]
    rows = [(rng.randrange(-50, 200), "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for _ in range(120)]
    rows += [(500, None), (501, ""), (None, pool[0]), (502, "\n\n"), (7, pool[1]), (7, pool[1]), (503, "\n".join([pool[2]] * 5000))]
    check(spark, rows)
    check(spark, rows, batches=7)


def test_ids_over_the_whole_range_of_longs(spark):
    line = "a line that stands in many documents"
    rows = [(i, line) for i in (-(1 << 63), (1 << 63) - 1, 0, 1, 2, 3, 4)]
    check(spark, rows)
    check(spark, rows, batches=5)


def test_batches_follow_the_lines(spark, monkeypatch):
    rows = [(i, "\n".join(f"a line of some length {(i * 7 + k) % 40}" for k in range(5))) for i in range(100)]
    monkeypatch.setattr(ld, "BATCH_LINES", 60)
    hashes = ld.line_hashes(spark.createDataFrame(rows, "doc_id long, text string"))
    parts = [b.count() for b in ld._batches(hashes, None)]
    assert len(parts) == 9 and sum(parts) == 500 and max(parts) < 100
    check(spark, rows)


def test_no_long_line_and_no_row(spark):
    check(spark, [(1, "a\nb"), (2, None)])
    check(spark, [])


def test_runs_are_levelled(spark):
    runs = ld.LineRuns(spark, buckets=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(100 - 10 * b - i, bytes([i % 4])) for i in range(8)], "doc_id long, h binary"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.h[0], r.last_doc) for r in runs.repeated(10).collect()} == {(0, 100), (1, 99), (2, 98), (3, 97)}
    runs.drop()
