from __future__ import annotations

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from namewright.functions.similarity import ratio
from namewright.functions.text import normalize_key
from namewright.operators import cascade, matching, results

NAMES = ["Lightning Bolt", "Lightning Helix", "Serra Angel", "Prosperity", "Fire // Ice", "Ice", "Counterspell", "Opt", "Will-o'-the-Wisp", "Waste Land", "Wasteland", "Shock"]


def index_rows(names=NAMES):
    return [(normalize_key(n), n, f"id{i // 1:03d}", "en", i) for i, n in enumerate(names)]


def shards(spark, rows=None, **more):
    return matching.shards(spark.createDataFrame(rows or index_rows(), matching.INDEX_SCHEMA), **more)


def brute(query, rows, n=3):
    best = {}
    for key, name, oracle, lang, at in rows:
        r = ratio(query, key)
        if oracle not in best or (r, -at) > (best[oracle][0], -best[oracle][4]):
            best[oracle] = (r, key, name, lang, at)
    ranked = sorted(best.items(), key=lambda e: (-e[1][0], e[0]))[:n]
    return [(oracle, b[1], round(b[0], 3)) for oracle, b in ranked]


def test_candidates_against_brute_force_in_any_number_of_shards(spark):
    rng = random.Random(0)
    rows = [("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9))).strip() or "a", f"n{i}", f"id{rng.randrange(20):02d}", "en", i) for i in range(150)]
    queries = ["abc", "a b", "cab ba", "aaaa", "b" * 80]
    df = spark.createDataFrame([(q,) for q in queries], "key string")
    for size in (10_000, 40):
        got = {r.key: [(c.oracle_id, c.key, round(c.score, 3)) for c in r.candidates] for r in matching.top_candidates(df, shards(spark, rows, shard_keys=size)).collect()}
        assert got == {q: brute(q, rows) for q in queries}


def test_ties_go_to_the_earliest_entry(spark):
    rows = [("abd", "later", "x", "en", 5), ("abc", "earlier", "x", "pt", 2), ("abc", "same key later", "x", "en", 3)]
    df = spark.createDataFrame([("ab",)], "key string")
    (row,) = matching.top_candidates(df, shards(spark, rows)).collect()
    assert [(c.name, c.lang) for c in row.candidates] == [("earlier", "pt")]


def test_statuses(spark):
    lines = ["Lightning Bolt", "Lightning Bolt 3 @@", "Ice", "12 3", "", None, "{T}", "Opt", "Lightnin", "Æ"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    got = {r.i: (r.status, len(r.candidates)) for r in matching.match_lines(df, shards(spark)).collect()}
    assert got[0] == ("auto", 3) and got[1] == ("auto", 3) and got[2][0] == "auto" and got[3] == ("empty", 0) and got[4] == ("empty", 0) and got[5] == ("empty", 0)
    assert got[6][0] == "review" and got[7][0] == "auto" and got[8][0] == "review" and got[9] == ("empty", 0)


def test_empty_index_and_lines(spark):
    none = matching.shards(spark.createDataFrame([], matching.INDEX_SCHEMA))
    df = spark.createDataFrame([("Bolt",)], "raw string")
    assert [(r.status, r.candidates) for r in matching.match_lines(df, none).collect()] == [("review", [])]
    assert matching.match_lines(df.limit(0), none).count() == 0


def test_guards(spark):
    lines = ["PROSPERITY", "Prosperity", "Waste Land", "Shock 2R", "OPT", "Shock"]
    df = spark.createDataFrame([(i, x, 0.5) for i, x in enumerate(lines)], "i int, raw string, confidence double")
    got = {r.raw: r.status for r in cascade.match_readings(df, shards(spark)).collect()}
    assert got == {"PROSPERITY": "review", "Prosperity": "auto", "Waste Land": "review", "Shock 2R": "auto", "OPT": "review", "Shock": "auto"}


def test_guards_look_at_the_line_as_read(spark):
    """The five letters of a line with its cost are no fragment, though those of the name alone would be."""
    index = shards(spark, [("abc", "ABC", "id", "en", 0)])
    df = spark.createDataFrame([(1, "ABC UU", 0.5), (2, "ABC", 0.5), (2, "ABC", 0.5), (3, None, 0.5)], "i int, raw string, confidence double")
    got = sorted((r.i, r.status, r.key) for r in cascade.match_readings(df, index).collect())
    assert [(i, s) for i, s, _ in got] == [(1, "auto"), (2, "review"), (2, "review"), (3, "empty")] and got[0][2] == "abc"


def reading(raw, score, status, confidence=0.5):
    return Row(raw=raw, confidence=confidence, cleaned=raw, key=raw, candidates=[Row(name=raw, oracle_id=raw, lang="en", key=raw, score=float(score))], status=status)




def fold(spark, first, second):
    kind = "first struct<raw:string,confidence:double,cleaned:string,key:string,candidates:array<struct<name:string,oracle_id:string,lang:string,key:string,score:double>>,status:string>"
    df = spark.createDataFrame([(first, second)], f"{kind}, {kind.replace('first', 'second', 1)}")
    r = df.select(cascade.reread(F.col("first"), F.col("second")).alias("r")).first().r
    return r.raw, r.status


def test_reread_rules(spark):
    auto, weak = reading("fast", 96, "auto"), reading("fast", 70, "review")
    assert fold(spark, weak, reading("slow", 60, "auto")) == ("slow", "auto")
    assert fold(spark, auto, reading("slow", 80, "review")) == ("fast", "review")
    assert fold(spark, auto, reading("slow", 97, "review")) == ("slow", "review")
    assert fold(spark, weak, reading("slow", 70, "review", 0.6)) == ("slow", "review")
    assert fold(spark, weak, reading("slow", 70, "review", 0.5)) == ("fast", "review")
    assert fold(spark, auto, None) == ("fast", "auto")


def test_assembly(spark):
    slots = spark.createDataFrame([("p", 1, 2, "auto"), ("p", 1, 1, "auto"), ("p", 2, 1, "review")], "image string, column long, slot int, status string")
    plan = spark.createDataFrame([("p", 1, True, 2, True), ("p", 2, True, 1, True), ("p", 3, True, 0, True), ("p", 4, False, 0, True), ("p", 5, False, 20, False)], "image string, column long, stop_card boolean, n_cards int, readable boolean")
    columns = results.assemble_columns(plan, slots, ["image"])
    got = {r.column: (r.status, r.n_cards, [s.slot for s in r.slots]) for r in columns.collect()}
    assert got == {1: ("ok", 2, [1, 2]), 2: ("error", 1, [1]), 3: ("ok", 0, []), 4: ("error", 0, []), 5: ("error", 0, [])}
    photos = results.assemble_photos(columns, spark.createDataFrame([("p", "C4", 1), ("q", "C6", 0)], "image string, config string, unreadable int"))
    nested = {r.image: r for r in photos.collect()}
    assert nested["p"].status == "retake" and [c.column for c in nested["p"].columns] == [1, 2, 3, 4, 5] and nested["q"].columns == []
