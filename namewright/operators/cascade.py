"""The reader cascade: only doubtful rows are read again, by costlier readers or other crops.

A reading is a row (slot keys, raw, confidence, cleaned, key, candidates, status). Every step filters first, so a costlier
reader sees just the rows that need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.functions.text import decoy_or_fragment, equal_ignoring_spaces, looks_like_name, squashed, strip_mana_token, title_case_start, too_short_for_auto
from namewright.operators.matching import EPSILON, IndexShards, match_lines
from namewright.session import cut

TRUSTED_SCORE = 95.0
READING = ["raw", "confidence", "cleaned", "key", "candidates", "status"]


def best_score(candidates: Column) -> Column:
    return F.coalesce(F.get(candidates, F.lit(0))["score"], F.lit(0.0))


def best_key(candidates: Column) -> Column:
    return F.get(candidates, F.lit(0))["key"]


def space_ambiguous(candidates: Column) -> Column:
    """The first two candidates differ in spaces only."""
    return F.coalesce(squashed(best_key(candidates)) == squashed(F.get(candidates, F.lit(1))["key"]), F.lit(False))


def guarded_status(status: Column, raw: Column, key: Column, candidates: Column) -> Column:
    """``auto`` becomes ``review`` where a guard speaks against it; no guard ever promotes."""
    doubt = decoy_or_fragment(raw, best_key(candidates)) | space_ambiguous(candidates) | too_short_for_auto(key)
    return F.when((status == "auto") & F.coalesce(doubt, F.lit(False)), "review").otherwise(status)


def match_readings(lines: DataFrame, index: IndexShards) -> DataFrame:
    """Match each line (raw, confidence and any keys) as read and, where it ends in a cost, without it; the stripped form
    is kept only if its score is strictly greater. Guards follow, on the line as read.

    Each different line is matched once, and lines and what was found are written, since the cascade uses them several times.
    """
    lines = cut(lines, "lines")
    stripped = strip_mana_token(F.col("raw"))
    asked = lines.select(F.explode(F.array(F.col("raw"), F.coalesce(stripped, F.col("raw")))).alias("line")).distinct()
    found = cut(match_lines(asked, index, "line"), "matched-lines")
    packed = found.select(F.col("line").alias("_at"), F.struct("cleaned", "key", "candidates", "status").alias("m"))
    rows = lines.withColumn("_stripped", stripped)
    both = rows.join(packed.withColumnRenamed("m", "_m"), F.col("raw").eqNullSafe(F.col("_at"))).drop("_at")
    both = both.join(packed.withColumnRenamed("m", "_n"), F.col("_stripped") == F.col("_at"), "left").drop("_at")
    better = F.coalesce(best_score(F.col("_n.candidates")) > best_score(F.col("_m.candidates")), F.lit(False))
    kept = both.withColumn("m", F.when(better, F.col("_n")).otherwise(F.col("_m"))).select(*lines.columns, "m.cleaned", "m.key", "m.candidates", "m.status")
    return kept.withColumn("status", guarded_status(F.col("status"), F.col("raw"), F.col("key"), F.col("candidates")))


def trusted(status: Column, raw: Column, key: Column, candidates: Column) -> Column:
    """Whether a fast reading stands without a second look."""
    plain = looks_like_name(raw) | (title_case_start(raw) & F.coalesce(equal_ignoring_spaces(best_key(candidates), key), F.lit(False)))
    return (status == "auto") & ((best_score(candidates) >= TRUSTED_SCORE - EPSILON) | plain)


def reading(alias: str = "") -> Column:
    return F.struct(*(F.col(f"{alias}{c}").alias(c) for c in READING))


def better_than(one: Column, other: Column) -> Column:
    """Score, then confidence, strictly greater."""
    s, t = best_score(one["candidates"]), best_score(other["candidates"])
    return (s > t) | ((s == t) & (one["confidence"] > other["confidence"]))


def reread(first: Column, second: Column) -> Column:
    """An untrusted first reading and the accurate one. An accurate auto replaces it; else the better of the two stays, and
    where the fast one was auto its status becomes review."""
    better = F.when(better_than(second, first), second).otherwise(first)
    demoted = F.when(first["status"] == "auto", better.withField("status", F.lit("review"))).otherwise(better)
    return F.when(second.isNull(), first).when(second["status"] == "auto", second).otherwise(demoted)


def reread_untrusted(fast: DataFrame, accurate_lines: DataFrame, index: IndexShards, keys: list[str]) -> DataFrame:
    """``fast`` readings with those not trusted replaced or demoted by accurate readings of the same slots."""
    doubt = fast.where(~trusted(F.col("status"), F.col("raw"), F.col("key"), F.col("candidates"))).select(*keys)
    again = match_readings(accurate_lines.join(doubt, keys, "left_semi"), index).select(*keys, reading().alias("_second"))
    joined = fast.select(*keys, reading().alias("_first")).join(again, keys, "left")
    return joined.withColumn("_r", reread(F.col("_first"), F.col("_second"))).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in READING))


def fallback(current: DataFrame, variant_lines: DataFrame, index: IndexShards, keys: list[str]) -> DataFrame:
    """Rows that are not auto take the best reading of their variants, folded strictly in order of ``variant``."""
    open_ = current.where("status <> 'auto'").select(*keys)
    tried = match_readings(variant_lines.join(open_, keys, "left_semi"), index)
    listed = tried.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("variant", reading().alias("r")))).alias("_tried"))
    joined = current.select(*keys, reading().alias("_first")).join(listed, keys, "left")
    fold = F.aggregate(F.transform(F.coalesce("_tried", F.array().cast(listed.schema["_tried"].dataType)), lambda v: v["r"]), F.col("_first"), lambda best, r: F.when(better_than(r, best), r).otherwise(best))
    return joined.withColumn("_r", fold).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in READING))
