from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from namewright.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, last int"


def brute(rows):
    out = {}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in groups.items():
        turns.sort()
        said = [t[3] for t in turns if t[2] == "assistant"]
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len("".join(said)), sha("".join(said)))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(chat.format_examples(df)).collect()}
    assert got == brute(rows)


def test_edges_of_the_input(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\0\\1", "<s>[user]x</s><s>[assistant]y</s>", "\\", "é😀\n]", "", None]
    rows = [(1, i, ["user", "assistant", "sys]tem", None][i % 4], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", "only a question"), (3, 0, "assistant", "only an answer"), (4, None, "user", "b"), (4, 1, "assistant", "c"), (4, 1, "assistant", "c"), (None, 0, "assistant", "z")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"text {i} " * 20) for i in range(300)] + [(6, 0, "assistant", "x" * 200_000)]
    check(spark, rows)


def test_masks_cover_just_the_target(spark):
    df = spark.createDataFrame([(1, 0, "user", "[a]"), (1, 1, "assistant", "<b>"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_examples(df).collect(), key=lambda r: r.example)
    assert [r.formatted for r in rows][0] == "<s>[user]\\2a\\3</s><s>[assistant]\\1b></s>"
    assert [r.formatted[r.mask_start : r.mask_end] if r.mask_start >= 0 else None for r in rows] == ["\\1b>", "d", None]
    assert [r.last for r in rows] == [False, False, True]
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(rows, rows[1:], strict=False))


def test_escape_round_trip(spark):
    texts = ["\\0", "\\\\1", "<[]>\\", "\\1<", "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("back"), chat.escape(F.col("t")).alias("e"))
    assert all(r.t == r.back and not re.search(r"[<\[\]]", r.e) for r in df.collect())


def test_plan_holds_no_python(spark, sf_dir):
    plan = chat.op8_chat(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = chat.op8_chat(spark, sf_dir).collect()
    assert len(got) == len(Counter(r[0] for r in rows)) + 1
    assert brute(rows) == {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got if r.conv_id != -7}


def test_empty_table(spark):
    assert chat.digest(chat.format_examples(spark.createDataFrame([], SCHEMA))).count() == 0
