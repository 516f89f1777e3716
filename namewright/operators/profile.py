"""Timing summaries: nearest-rank percentiles, shares, averages of nested fields, counters and reader comparisons."""

from __future__ import annotations

import resource

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.session import cut


def running_count(counted: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """``counted`` with _upto (the count of its key's values up to its own) and _n (its key's whole count).

    Rows are range-partitioned by key and value, and only the sums of each key in each partition are put in order, so that a
    key with a large share of all rows is not one task's work.
    """
    ranged = cut(counted.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(count).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_at"), F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("_n"))
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = F.sum(count).over(Window.partitionBy(*keys, "_part").orderBy(value))
    return ranged.withColumn("_within", within).join(sums, same).withColumn("_upto", F.col("_before") + F.col("_within")).select(*counted.columns, "_upto", "_n")


def nearest_rank(values: DataFrame, value: str, quantiles: dict[str, float], keys: list[str]) -> DataFrame:
    """Nearest-rank percentiles: the value at place round((n - 1) q) of the sorted ones, halves up. Nulls are left out."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = running_count(counted, keys, value, "_c")
    at = {name: F.floor((F.col("_n") - 1) * q + 0.5) for name, q in quantiles.items()}
    picks = [F.min(F.when(F.col("_upto") > place, F.col(value))).alias(name) for name, place in at.items()]
    return upto.groupBy(*keys).agg(*picks)


def means(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def share_of_total(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Each group's mean in per cent of the sum of all groups' means."""
    mean = rows.groupBy(key).agg(F.avg(value).alias("mean"))
    total = mean.agg(F.sum("mean").alias("total"))
    return mean.crossJoin(F.broadcast(total)).select(key, "mean", (100.0 * F.col("mean") / F.col("total")).alias("share"))


def stage_means(photos: DataFrame, struct: str = "timing_ms") -> DataFrame:
    """The average of every number in a nested timing struct, as one row with flat names."""
    picks = []

    def walk(kind, path: str) -> None:
        for f in kind.fields:
            here = f"{path}.{f.name}"
            if f.dataType.typeName() == "struct":
                walk(f.dataType, here)
            else:
                picks.append(F.avg(here).alias(here.removeprefix(f"{struct}.").replace(".", "_")))

    walk(photos.schema[struct].dataType, struct)
    return photos.agg(*picks)


def crops_per_slot(lines: Column, slots: Column) -> Column:
    """0 where there is no slot."""
    return F.when(slots > 0, lines / slots).otherwise(0.0)


def gate_summary(tallies: DataFrame, timings: DataFrame, key: str) -> DataFrame:
    """One line per set: its evaluation and its mean time, lines read and pixels."""
    return tallies.join(timings, key)


def reader_comparison(lines: DataFrame, key: str = "reader") -> DataFrame:
    """Per reader over lines (truth, text, status, oracle_id, true_oracle, lang): exact text, right autos, wrong autos.

    Lines in other languages than the index's are left out.
    """
    own = lines.where("lang <> 'other'")
    auto = F.col("status") == "auto"
    right = auto & (F.col("oracle_id") == F.col("true_oracle"))
    percent = lambda c: 100.0 * F.count_if(c) / F.count("*")
    return own.groupBy(key).agg(F.count("*").alias("lines"), percent(F.col("text") == F.col("truth")).alias("exact"), percent(right).alias("auto_ok"), F.count_if(auto & ~right).alias("wrong"))


def set_statistics(slots: DataFrame, by: str) -> DataFrame:
    """Counts of a set by one attribute, with distinct printings and entities."""
    return slots.groupBy(by).agg(F.count("*").alias("slots"), F.countDistinct("printing").alias("printings"), F.countDistinct("oracle_id").alias("oracles"))


def process_cpu_seconds() -> float:
    """User and system time of this process so far; executors' times are in Spark's task metrics."""
    used = resource.getrusage(resource.RUSAGE_SELF)
    return used.ru_utime + used.ru_stime
