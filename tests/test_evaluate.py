from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from namewright.operators import evaluate, index, profile
from namewright.sources import readers, writers


def test_slot_rules(spark):
    schema = "image string, slot int, oracle_id string, lang string, tags array<string>, level string, category string, config string"
    truth = spark.createDataFrame([("a", 1, "x", "en", None, "l", "c", "C4"), ("a", 2, "x", "other", None, "l", "c", "C4"), ("a", 3, "x", "en", ["split_sideways"], "l", "c", "C4"), ("a", 4, "x", "en", [], "l", "c", "C4"), ("a", 5, "x", "en", None, "l", "c", "C4")], schema)
    got = spark.createDataFrame([("a", 1, "auto", "x"), ("a", 2, "auto", "y"), ("a", 3, "auto", "x"), ("a", 4, "review", None), ("a", 9, "auto", "z")], "image string, slot int, status string, oracle_id string")
    rows = {r.slot: r for r in evaluate.slot_tallies(truth, got, ["image", "slot"]).collect()}
    assert [rows[1][c] for c in ("scored", "auto_ok", "auto_ok_all", "wrong")] == [1, 1, 1, 0]
    assert [rows[2][c] for c in ("scored", "auto_ok", "auto_ok_all", "wrong")] == [0, 0, 0, 1]
    assert [rows[3][c] for c in ("scored", "auto_ok", "auto_ok_all", "wrong")] == [0, 0, 1, 0]
    assert [rows[4][c] for c in ("review", "empty")] == [1, 0] and [rows[5][c] for c in ("review", "empty")] == [0, 1]
    assert [r.slot for r in evaluate.phantom_autos(truth, got, ["image", "slot"]).collect()] == [9]


def test_column_rules(spark):
    truth = spark.createDataFrame([(1, 5, "ok", False), (2, 5, "ok", False), (3, 5, "ok", False), (4, 0, "error", True), (5, 0, "error", True), (6, 0, "error", True)], "column int, n_cards int, expect_status string, negative boolean")
    got = spark.createDataFrame([(1, 5, "ok"), (2, 4, "ok"), (4, 0, "error"), (5, 0, "ok")], "column int, n_cards int, status string")
    rows = {r.column: (r.count_errors, r.status_errors) for r in evaluate.column_tallies(truth, got, ["column"]).collect()}
    assert rows == {1: (0, 0), 2: (1, 0), 3: (2, 0), 4: (0, 0), 5: (0, 1), 6: (1, 1)}


def test_photo_rules(spark):
    truth = spark.createDataFrame([("a", "C4", "ok"), ("b", "C4", "ok"), ("c", "C6", "retake"), ("d", "C4", "ok")], "image string, config string, expect_status string")
    got = spark.createDataFrame([("a", "ok", "C6"), ("c", "retake", "C4"), ("d", "retake", "C4")], "image string, status string, config string")
    rows = {r.image: (r.missing, r.retake, r.status_errors) for r in evaluate.photo_tallies(truth, got).collect()}
    assert rows == {"a": (0, 0, 1), "b": (1, 0, 0), "c": (0, 1, 0), "d": (0, 0, 1)}


def test_tally_and_verdict(spark):
    rows = spark.createDataFrame([("i1", "en", 1, 1), ("i1", None, 1, 0), ("i2", "en", 1, 1)], "image string, lang string, scored int, auto_ok int")
    got = {(r.grouping, r.value): (r.scored, r.auto_ok) for r in evaluate.tally(rows, ["image", "lang"], ["scored", "auto_ok"]).collect()}
    assert got == {("total", None): (3, 2), ("image", "i1"): (2, 1), ("image", "i2"): (1, 1), ("lang", "en"): (2, 2), ("lang", None): (1, 0)}
    total = spark.createDataFrame([(100, 96, 0, 0, 0, 0), (100, 96, 1, 0, 0, 0), (100, 90, 0, 0, 0, 0), (0, 0, 0, 0, 0, None)], "scored int, auto_ok int, wrong int, status_errors int, count_errors int, missing int")
    assert [r.verdict for r in evaluate.verdict(total).collect()] == ["PASS", "FAIL", "FAIL", "FAIL"]
    assert math.isnan(total.where("scored = 0").select(evaluate.auto_rate(F.col("auto_ok"), F.col("scored"))).first()[0])


def test_nearest_rank(spark):
    rng = random.Random(1)
    values = {g: [rng.choice([1.0, 2.5, 7.0, 9.5, rng.random()]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 31), ("d", 20))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in profile.nearest_rank(df, "v", {"p50": 0.5, "p95": 0.95}, ["g"]).collect()}
    pick = lambda vs, q: sorted(vs)[int((len(vs) - 1) * q + 0.5)]
    assert got == {g: (pick(vs, 0.5), pick(vs, 0.95)) for g, vs in values.items()}


def test_index_build_and_files(spark, tmp_path):
    catalogue = '{"meta": {"date": "d", "version": "v"}, "data": {"Fire // Ice": [{"name": "Fire // Ice", "faceName": "Fire", "layout": "split", "side": "a", "identifiers": {"scryfallOracleId": "o1"}, "foreignData": [{"language": "Portuguese (Brazil)", "name": "Fogo // Gêlo"}, {"language": "German", "name": "Feuer"}]}, {"name": "Fire // Ice", "faceName": " Ice ", "layout": "split", "side": "b", "identifiers": {"scryfallOracleId": "o1"}}], "Hero // Bolt": [{"name": "Hero // Bolt", "faceName": "Bolt", "layout": "adventure", "side": "b", "identifiers": {"scryfallOracleId": "o2"}}], "Tok": [{"name": "Tok", "layout": "token", "identifiers": {"scryfallOracleId": "o3"}}], "None": [{"name": "None", "layout": "normal", "identifiers": {}}]}}'
    (tmp_path / "cat.json").write_text(catalogue, encoding="utf-8")
    entries = index.index_entries(readers.read_catalogue(spark, str(tmp_path / "cat.json")))
    rows = [(r.entry_idx, r.lang, r.key, r.name) for r in entries.orderBy("entry_idx").collect()]
    assert rows == [(0, "en", "fire", "Fire"), (1, "en", "fire ice", "Fire // Ice"), (2, "en", "hero bolt", "Hero // Bolt"), (3, "en", "ice", "Ice"), (4, "pt", "fogo gelo", "Fogo // Gêlo")]
    path = str(tmp_path / "names.json")
    writers.write_index(entries, path, "made")
    back = readers.read_name_index(spark, path)
    assert sorted(map(tuple, back.select("entry_idx", "lang", "key", "name").collect())) == rows
    with open(path, encoding="utf-8") as f:
        assert len(f.read().splitlines()) == 7


def test_solvable_and_quota(spark):
    entries = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "a")], "key string, oracle_id string")
    cards = spark.createDataFrame([("k1", "a"), ("k2", "a"), ("k2", "b")], "key string, oracle_id string")
    assert [tuple(r) for r in index.solvable(cards, entries).collect()] == [("k2", "a")]
    pool = spark.createDataFrame([(i, "c" if i % 3 else "d", i % 5) for i in range(60)], "id int, category string, oracle int")
    one = index.quota_sample(pool, "category", "id", 4, "s", one_per="oracle").collect()
    two = index.quota_sample(pool.repartition(7), "category", "id", 4, "s", one_per="oracle").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 8 and len({(r.category, r.oracle) for r in one}) == 8


def test_sources(spark, tmp_path):
    (tmp_path / "bulk.json").write_text('[\n{"id": 1, "name": "a"},\n{"id": 2, "name": "b"}\n]\n')
    assert [tuple(r) for r in readers.read_bulk_lines(spark, str(tmp_path / "bulk.json"), "id int, name string").collect()] == [(1, "a"), (2, "b")]
    (tmp_path / "dict.txt").write_text("a\r\nb\n \n")
    assert readers.read_dictionary(spark, str(tmp_path / "dict.txt")) == ["a", "b", " "]
    (tmp_path / "bad.json").write_text('{"version": 2, "entries": []}')
    try:
        readers.read_name_index(spark, str(tmp_path / "bad.json"))
        raise AssertionError("version 2 was read")
    except ValueError:
        pass
    images = spark.createDataFrame([("x/one.jpg",), ("two.jpg",), ("a/img1.jpg",), ("both.jpg",), ("file:///p/q.tar.gz",), ("none.jpg",)], "image string")
    got = spark.createDataFrame([("one", "ok"), ("two", "ok"), ("img1.jpg", "retake"), ("both", "ok"), ("both.jpg", "retake"), ("q.tar", "ok")], "stem string, status string")
    assert {r.image: r.status for r in readers.results_for(images, got).collect()} == {"x/one.jpg": "ok", "two.jpg": "ok", "a/img1.jpg": "retake", "both.jpg": "ok", "file:///p/q.tar.gz": "ok", "none.jpg": None}
    manifest = '{"spec_version": 1, "set": "s", "images": {"a.jpg": {"config": "C4", "level": "easy", "columns": [{"column": 1, "n_cards": 1, "slots": [{"slot": 1, "oracle_id": "o", "lang": "en"}]}]}}}'
    (tmp_path / "manifest.json").write_text(manifest)
    rows = readers.manifest_slots(readers.read_manifest(spark, str(tmp_path / "manifest.json"))).collect()
    assert [(r.image, r.config, r.column, r.slot, r.oracle_id) for r in rows] == [("a.jpg", "C4", 1, 1, "o")]


def test_resume_appends_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert writers.write_new(rows.limit(1), path, "id") == 1
    assert writers.write_new(rows, path, "id") == 1 and writers.write_new(rows, path, "id") == 0
    assert "| id | v |" in writers.markdown(rows)
