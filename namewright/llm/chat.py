r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. A turn
is written as `<s>[role]text</s>`. In roles and texts the characters `\ < [ ]` are escaped as `\0 \1 \2 \3`, so no text can
hold a control string, and replacing `\1 \2 \3` and then `\0` back restores it. A conversation that goes on after its last
assistant turn gets one more example without a target, so that the output holds every turn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import read

#: The template and its escapes, the escape character first.
OPEN, ROLE_OPEN, ROLE_CLOSE, CLOSE = "<s>", "[", "]", "</s>"
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3")]
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), [*ESCAPES[1:], ESCAPES[0]], text)


def format_examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (its place), formatted, mask_start, mask_end (-1 where nothing is trainable), last.

    ``turns`` has conv_id, turn, role, text; the mask is [mask_start, mask_end) in code points of ``formatted``. A
    conversation is written once, and its examples are prefixes of that string. Defined cases: a null text or role is
    empty; turns are ordered by turn, then role and text, a null turn first; repeated rows are turns of their own; a null
    conv_id is a conversation; an empty table gives no rows; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN + ROLE_OPEN), escape(t["role"]), F.lit(ROLE_CLOSE))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == TARGET_ROLE).alias("target")))
    written = whole.select("conv_id", parts.alias("parts")).withColumn("formatted", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    lengths = F.transform("parts", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["target"].alias("target")))
    # Ends of turns by a running sum in a scan over the lengths.
    ended = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,target:boolean>>").alias("ends")),
        lambda s, p: F.struct(
            (s["at"] + p["head"] + p["body"] + len(CLOSE)).alias("at"),
            F.concat(s["ends"], F.array(F.struct((s["at"] + p["head"]).alias("start"), (s["at"] + p["head"] + p["body"]).alias("end"), p["target"].alias("target")))).alias("ends"),
        ),
        lambda s: s["ends"],
    )
    placed = written.select("conv_id", "formatted", ended.alias("ends"))
    chosen = F.filter("ends", lambda e: e["target"] | (e["end"] + len(CLOSE) == F.length("formatted")))
    rows = placed.select("conv_id", "formatted", F.posexplode(chosen).alias("example", "e"))
    end = F.col("e.end") + len(CLOSE)
    return rows.select(
        "conv_id",
        "example",
        F.substring("formatted", F.lit(1), end).alias("formatted"),
        F.when(F.col("e.target"), F.col("e.start")).otherwise(-1).alias("mask_start"),
        F.when(F.col("e.target"), F.col("e.end")).otherwise(-1).alias("mask_end"),
        (end == F.length("formatted")).alias("last"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    pieces = F.split(F.substring(formatted, F.lit(len(OPEN + ROLE_OPEN) + 1), F.length(formatted)), "</s>(?:<s>\\[|$)", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    parts = F.transform(turns, lambda t: F.split(t, "\\]", 2))
    return F.transform(parts, lambda p: F.struct(unescape(F.get(p, 0)).alias("role"), unescape(F.get(p, 1)).alias("text")))


def read_target(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, null where there is none."""
    return F.when(start >= 0, unescape(F.substring(formatted, start + 1, end - start)))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text and the size of the output."""
    turns = F.when(F.col("last"), read_turns(F.col("formatted")))
    parsed = examples.select("conv_id", "example", F.length("formatted").alias("chars"), turns.alias("turns"), read_target(F.col("formatted"), F.col("mask_start"), F.col("mask_end")).alias("target"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    own = parsed.select("conv_id", "example", "chars", F.size("turns").alias("n"), F.sha2(said, 256).alias("sha"), "turns", "target")
    targets = F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))
    grouped = own.groupBy("conv_id").agg(
        F.max(F.when(F.col("turns").isNotNull(), F.col("n"))).cast("long").alias("n_turns"),
        F.max(F.when(F.col("turns").isNotNull(), F.col("sha"))).alias("turns_sha256"),
        F.array_sort(targets).alias("targets"),
        F.sum(F.col("chars").cast("long")).alias("formatted_chars"),
    )
    loss = F.array_join(F.col("targets.target"), "")
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    said = F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(said)).withColumn("text", F.lit(hostile))
    return digest(format_examples(turns.unionByName(extra)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 9 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM turns
), placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY from_end DESC) AS ends FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY from_end DESC)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY from_end DESC) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(ends) FILTER (role = 'assistant' OR from_end = 1))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""
