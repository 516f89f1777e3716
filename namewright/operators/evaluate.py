"""Scoring of results against truth, tallied over several groupings at once by grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TALLY = ["scored", "auto_ok", "auto_ok_all", "wrong", "review", "empty", "status_errors", "count_errors"]
GROUPINGS = ["image", "lang", "level", "category", "config"]


def scored_slots(lang: Column, tags: Column) -> Column:
    return (lang != "other") & ~F.array_contains(F.coalesce(tags, F.array().cast("array<string>")), "split_sideways")


def slot_tallies(truth: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """A row of counters for each true slot (keys, oracle_id, lang, tags, image attributes), by its result (keys, status, oracle_id).

    A wrong auto counts even where the slot is not scored; any status other than auto and review counts as empty.
    """
    got = results.select(*keys, F.col("status").alias("_status"), F.col("oracle_id").alias("_oracle"))
    joined = truth.join(got, keys, "left")
    counts = scored_slots(F.col("lang"), F.col("tags"))
    auto = F.col("_status").eqNullSafe("auto")
    right = auto & F.col("_oracle").eqNullSafe(F.col("oracle_id"))
    flags = {
        "scored": counts,
        "auto_ok": right & counts,
        "auto_ok_all": right,
        "wrong": auto & ~right,
        "review": F.col("_status").eqNullSafe("review"),
        "empty": ~auto & ~F.col("_status").eqNullSafe("review"),
    }
    return joined.select(*truth.columns, *(f.cast("long").alias(n) for n, f in flags.items()), F.lit(0).cast("long").alias("status_errors"), F.lit(0).cast("long").alias("count_errors"))


def phantom_autos(truth: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Auto results of slots that the truth does not have: each is one wrong of its image, level and config, and of the total,
    but of no language or category."""
    return results.where("status = 'auto'").join(truth, keys, "left_anti")


def column_tallies(truth: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of columns: truth (keys, n_cards, expect_status, negative), results (keys, n_cards, status).

    A missing column is a count error, and a second error for want of its count, which for a negative column is a status error.
    """
    got = results.select(*keys, F.col("n_cards").alias("_n"), F.col("status").alias("_status"), F.lit(True).alias("_there"))
    joined = truth.join(got, keys, "left")
    missing = F.col("_there").isNull()
    count = missing.cast("long") + (~F.col("negative") & ~F.col("_n").eqNullSafe(F.col("n_cards"))).cast("long")
    status = (F.col("negative") & ~F.col("_status").eqNullSafe(F.col("expect_status"))).cast("long")
    return joined.select(*truth.columns, count.alias("count_errors"), status.alias("status_errors"))


def photo_tallies(truth: DataFrame, results: DataFrame, key: str = "image") -> DataFrame:
    """Per expected photo: missing, retake (scored on status alone) and status errors (also where the config differs)."""
    got = results.select(key, F.col("status").alias("_status"), F.col("config").alias("_config"))
    joined = truth.join(got, key, "left")
    missing = F.col("_status").isNull()
    retake = F.col("expect_status") == "retake"
    error = F.when(missing, 0).otherwise((~F.col("_status").eqNullSafe(F.col("expect_status"))).cast("long") + (~retake & ~F.col("_config").eqNullSafe(F.col("config"))).cast("long"))
    return joined.select(*truth.columns, missing.cast("long").alias("missing"), retake.cast("long").alias("retake"), error.cast("long").alias("status_errors"))


def tally(rows: DataFrame, groupings: list[str], counters: list[str]) -> DataFrame:
    """The counters in total and by each grouping, in one aggregation: columns grouping, value and the counters."""
    sets = [[], *([g] for g in groupings)]
    number = F.lit(0)
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(g) for g in groupings))
    summed = grouped.agg(*(F.sum(c).cast("long").alias(c) for c in counters), *(F.grouping(g).alias(f"_{g}") for g in groupings))
    name = F.lit("total")
    for g in groupings:
        name = F.when(F.col(f"_{g}") == 0, g).otherwise(name)
        number = F.when(F.col(f"_{g}") == 0, F.col(g).cast("string")).otherwise(number.cast("string"))
    value = F.when(name == "total", F.lit(None).cast("string")).otherwise(number)
    return summed.select(name.alias("grouping"), value.alias("value"), *counters)


def auto_rate(auto_ok: Column, scored: Column) -> Column:
    """Per cent; NaN as printed for no scored slots (the gate takes 0 there)."""
    return F.when(scored > 0, 100.0 * auto_ok / scored).otherwise(float("nan"))


def verdict(total: DataFrame, min_auto: float = 95.0) -> DataFrame:
    """FAIL where anything is wrong, missing or miscounted or the rate is below the gate."""
    rate = F.when(F.col("scored") > 0, 100.0 * F.col("auto_ok") / F.col("scored")).otherwise(0.0)
    bad = (F.col("wrong") > 0) | (F.col("status_errors") > 0) | (F.col("count_errors") > 0) | (F.coalesce(F.col("missing"), F.lit(0)) > 0) | (rate < min_auto)
    return total.withColumn("rate", rate).withColumn("verdict", F.when(bad, "FAIL").otherwise("PASS"))
