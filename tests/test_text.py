from __future__ import annotations

import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namewright.functions import similarity as sim
from namewright.functions import text as t
from namewright.operators.matching import accept

#: Known facts: line, cleaned, key, best name, its score.
FACTS = [
    ("Counterspell", "Counterspell", "counterspell", "Counterspell", 100.0),
    ("Llanowar Elves (G)", "Llanowar Elves (G", "llanowar elves g", "Llanowar Elves", 93.33),
    ("Jace, the Mind Sculptor", "Jace, the Mind Sculptor", "jace the mind sculptor", "Jace, the Mind Sculptor", 100.0),
    ("Will o the Wisp", "Will o the Wisp", "will o the wisp", "Will-o'-the-Wisp", 100.0),
    ("Wrath of Gcd", "Wrath of Gcd", "wrath of gcd", "Wrath of God", 91.67),
    ("Anulação", "Anulação", "anulacao", "Danação", 80.0),
    ("Dragão Shivano", "Dragão Shivano", "dragao shivano", "Dragão Viashivano", 90.32),
    ("Gigante Esmaga-ossos", "Gigante Esmaga-ossos", "gigante esmaga ossos", "Gigante Esmaga-ossos", 100.0),
    ("{2}{R}", "{2}{R", "2 r", "TL;DR", 50.0),
    ("xqzv", "xqzv", "xqzv", "X", 40.0),
    ("12 3 @#", "", "", None, None),
    ("", "", "", None, None),
]
#: Rows (best score, runner-up, key length) and what the accept rule makes of them.
ACCEPTED = [(93.33, 80.0, 16, "auto"), (91.67, 83.33, 12, "auto"), (100.0, 60.0, 3, "auto"), (100.0, 100.0, 4, "review"), (90.32, 82.76, 14, "auto"), (80.0, 71.43, 8, "review"), (94.0, 10.0, 6, "review"), (100.0, 95.0, 13, "auto"), (100.0, 95.1, 13, "review"), (90.0, 0.0, 7, "auto")]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_golden_cases(spark):
    """All cases of a file that GOLDEN_CASES names: cleaned, key, best score and status of each line."""
    path = os.environ.get("GOLDEN_CASES")
    if not path:
        pytest.skip("GOLDEN_CASES names no file")
    with open(path, encoding="utf-8") as f:
        cases = json.load(f)["cases"]
    cleaned = column(spark, [c["raw"] for c in cases], lambda x: F.when(t.has_letter(x), t.clean(x)).otherwise(""))
    assert cleaned == [c["cleaned"] for c in cases]
    assert column(spark, cleaned, t.normalize) == [c["key"] for c in cases]
    for c in cases:
        if c.get("best_name"):
            assert sim.ratio(c["key"], t.normalize_key(c["best_name"])) == pytest.approx(c["best_score"], abs=0.01)
    scored = [c for c in cases if c["status"] != "empty"]
    candidate = "array<struct<score:double>>"
    rows = [(i, [(float(c["best_score"]),), (float(c["runner_up_score"] or 0.0),)], c["key"]) for i, c in enumerate(scored)]
    df = spark.createDataFrame(rows, f"i int, candidates {candidate}, key string")
    got = [r.s for r in df.select("i", accept(F.col("candidates"), F.col("key")).alias("s")).orderBy("i").collect()]
    assert got == [c["status"] for c in scored] and len(cases) > 50


def test_normalize(spark):
    got = column(spark, ["Relâmpago", "Fire // Ice", "Anulação", "Æther Vial", "ﬁsh ½", "", None, "  A  b "], t.normalize)
    assert got == ["relampago", "fire ice", "anulacao", "ther vial", "fish 1 2", "", None, "a b"]


def test_clean(spark):
    got = column(spark, ["Serra Angel 3 @@", "Counterspel1", "12 3 @#", "  a  b ", "Bolt {2}", "x" * 50_000 + " 1" * 50_000], t.clean)
    assert got == ["Serra Angel", "Counterspel", "", "a b", "Bolt", "x" * 50_000]


def test_cost_token(spark):
    lines = ["Dig Through Time 6UU", "Bolt UU ", "Bolt 2 ", "Ponder U", "6UU", "Bolt {2}", "Bolt 12", "Bolt {}", "Two\nLines 6UU"]
    assert column(spark, lines, t.strip_mana_token) == ["Dig Through Time", "Bolt", None, None, None, "Bolt", "Bolt", None, "Two\nLines"]


def test_shapes(spark):
    assert column(spark, ["WasteLand", "ENCHANTMENT", "Will-o'-the-Wisp", " Éa", "lower"], t.looks_like_name) == [False, False, True, True, False]
    assert column(spark, ["WasteLand", "ENCHANTMENT"], t.title_case_start) == [True, False]
    assert column(spark, ["abc", "12", "Ⅷ", "é"], t.has_letter) == [True, False, True, True]


def test_decoys(spark):
    decoy = lambda key: lambda x: t.decoy_or_fragment(x, F.lit(key))
    assert column(spark, ["PRASPERITY", "BAT", "CURIOSITY", "Bat", "12"], decoy("prosperity")) == [True, True, True, False, False]
    assert column(spark, ["CURIOSITY", "BAT"], decoy("curiosity")) == [False, True]


def test_facts(spark):
    raws = [f[0] for f in FACTS]
    assert column(spark, raws, t.clean) == [f[1] for f in FACTS]
    assert column(spark, raws, lambda x: t.normalize(t.clean(x))) == [f[2] for f in FACTS]
    assert all(abs(sim.ratio(key, t.normalize_key(name)) - score) < 0.01 for _, _, key, name, score in FACTS if name)


def test_accept_rule(spark):
    kind = "candidates array<struct<name:string,oracle_id:string,lang:string,key:string,score:double>>, key string"
    rows = [([(None, "a", None, None, best), (None, "b", None, None, second)], "k" * n) for best, second, n, _ in ACCEPTED]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(accept(F.col("candidates"), F.col("key"))).collect()]
    assert got == [a[3] for a in ACCEPTED]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_known_ratios():
    assert sim.ratio("this is a test", "this is a test!") == pytest.approx(96.55172413793103)
    assert sim.indel_distance("abc", "axc") == 2 and sim.ratio("", "") == 100.0 and sim.ratio("a", "") == 0.0


@settings(max_examples=150, deadline=None)
@given(st.text("abcé ", max_size=150), st.text("abcé ", max_size=150))
def test_kernel_equals_plain_lcs(a, b):
    assert sim.lcs_length(a, b) == plain_lcs(a, b)
    assert sim.ratio(a, b) == sim.ratio(b, a) and sim.ratio(a, a) == 100.0


def test_column_form_equals_kernel(spark):
    words = ["abcabc", "xbyczabc", "", "a" * 62, "ab" * 31, "zé", "the quick brown fox"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    rows = df.select("a", "b", sim.lcs_column(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == plain_lcs(r.a, r.b) for r in rows)


def test_published_score(spark):
    df = spark.createDataFrame([(96.55172413793103,), (92.85714285714286,), (100.0,)], "x double")
    assert [r[0] for r in df.select(sim.published_score(F.col("x"))).collect()] == [96.5517, 92.8571, 100.0]


def test_lcs_column_of_long_texts(spark):
    import random

    from namewright.functions import similarity

    rng = random.Random(6)
    rows = [("".join(rng.choice("abcd") for _ in range(n)), "".join(rng.choice("abcd") for _ in range(m))) for n in (0, 5, 61, 62, 63, 64, 65, 130) for m in (0, 7, 63, 90)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", similarity.lcs_column(df["a"], df["b"]).alias("n")).collect()
    assert all(r.n == similarity.lcs_length(r.a, r.b) for r in got) and len(got) == len(rows)
