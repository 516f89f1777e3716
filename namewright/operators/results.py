"""Assembly of slot, column and photo results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPEC_VERSION = 1
COLUMN_SLOTS = 20


def slot_fields(slots: DataFrame) -> DataFrame:
    """Name, oracle_id, lang and score of each reading; the first three only where the status is auto."""
    best = F.get(F.col("candidates"), F.lit(0))
    auto = F.col("status") == "auto"
    named = [F.when(auto, best[c]).alias(c) for c in ("name", "oracle_id", "lang")]
    listed = F.transform("candidates", lambda c: F.struct(c["name"].alias("name"), c["oracle_id"].alias("oracle_id"), c["score"].alias("score")))
    kept = [c for c in slots.columns if c not in ("candidates", "name", "oracle_id", "lang", "score")]
    return slots.select(*kept, *named, best["score"].alias("score"), listed.alias("candidates"))


def column_status(n_auto: Column, n_slots: Column, stop_card: Column, n_cards: Column) -> Column:
    """ok if every slot is auto (no slot: yes) and the end of the column is known."""
    return F.when((n_auto == n_slots) & (stop_card | (n_cards == COLUMN_SLOTS)), "ok").otherwise("error")


def assemble_columns(plan: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """One row per planned column (keys, column, stop_card, n_cards, readable): status and its slots in order.

    An unreadable column is an error without slots or cards.
    """
    fields = [c for c in slots.columns if c not in (*keys, "column", "slot")]
    own = slots.groupBy(*keys, "column").agg(F.array_sort(F.collect_list(F.struct("slot", *fields))).alias("slots"))
    joined = plan.join(own, [*keys, "column"], "left").withColumn("slots", F.coalesce("slots", F.array().cast(own.schema["slots"].dataType)))
    n_auto = F.size(F.filter("slots", lambda s: s["status"] == "auto"))
    status = F.when(F.col("readable"), column_status(n_auto, F.size("slots"), F.col("stop_card"), F.col("n_cards"))).otherwise("error")
    cards = F.when(F.col("readable"), F.col("n_cards")).otherwise(0)
    return joined.select(*keys, "column", status.alias("status"), "stop_card", cards.alias("n_cards"), F.when(F.col("readable"), F.col("slots")).otherwise(F.array().cast(own.schema["slots"].dataType)).alias("slots"))


def assemble_photos(columns: DataFrame, photos: DataFrame, key: str = "image") -> DataFrame:
    """One row per photo (key, config, unreadable): columns sorted; a photo with an unreadable column is a retake."""
    fields = ["column", "status", "stop_card", "n_cards", "slots"]
    own = columns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("columns"))
    joined = photos.join(own, key, "left")
    return joined.select(F.lit(SPEC_VERSION).alias("spec_version"), key, "config", F.when(F.col("unreadable") > 0, "retake").otherwise("ok").alias("status"), F.coalesce("columns", F.array().cast(own.schema["columns"].dataType)).alias("columns"))


def slot_rows(photos: DataFrame, key: str = "image") -> DataFrame:
    """Nested results exploded back to a row per slot."""
    cols = photos.select(key, F.explode("columns").alias("c"))
    return cols.select(key, "c.column", F.explode("c.slots").alias("s")).select(key, "column", "s.*")


def status_summary(slots: DataFrame, *keys: str) -> DataFrame:
    """Slots by status for each group."""
    return slots.groupBy(*keys).agg(F.count("*").alias("slots"), *(F.count_if(F.col("status") == s).alias(s) for s in ("auto", "review", "empty")))
