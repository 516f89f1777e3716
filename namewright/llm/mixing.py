"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key -ln(u) / w, with u from a hash of its doc_id and w its quality weight; ascending
keys are a weighted sample without replacement. A source first gives as many complete epochs as its target holds; the
rest of the target is taken from its documents in key order, by prefix sums of their sizes.

Prefix sums run in two levels, so that a source with a third of all rows is no single task's work: keys are cut into
slices, slices are summed over each source, and only documents of one slice are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namewright.llm.common import read
from namewright.llm.quality import Forest, fitted, score_documents
from namewright.session import cut

SHARE = 1.5
MOST_TIMES = 2
WEIGHTS = (3, 1, 2)
#: Slices of the keys' logarithm, for a factor of e; with one weight no slice has over a thousandth of the rows.
SLICES = 512
LEAST_WEIGHT = 1e-6
SEED = 17
#: The column of the classifier's score.
WEIGHT = "quality_weight"


def size_of(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """The sources with their place in code point order (null last), counted in ranges rather than in one task."""
    spark = sources.sparkSession
    ranged = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    # One row per partition.
    before, offsets = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.join(spark.createDataFrame(offsets, "part int, before long"), "part").withColumn("place", F.col("before") + within).drop("part", "before")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST_TIMES, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The total is ``share`` of all sizes, dealt by weight; a target stops at ``most`` times its source's size and the excess is
    dealt anew over the others until none is above. Only sums reach the driver.
    """
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    ranked = cut(_ranked(sizes).withColumn("weight", F.get(kinds, F.pmod("place", F.lit(len(weights))).cast("int"))), "ranked")
    cap = F.col("source_size") * float(most)
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, n_full = 0.0, -1
    while True:
        # Sources whose cap is below their share at this level are full; the others share what those leave.
        full = cap <= F.col("weight") * level if n_full >= 0 else F.lit(False)
        r = ranked.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        left = total - (r[1] or 0.0)
        if r[0] == n_full or not r[2]:
            break
        n_full, level = r[0], left / r[2]
    return ranked.select("source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def _hot_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, left[on].eqNullSafe(right[f"{on}_"]), "left").drop(f"{on}_")


def mix(docs: DataFrame, quality: str | None = None, share: float = SHARE, most: float = MOST_TIMES, seed: int = SEED, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source).

    ``taken`` counts a document's words in the mix, repeats included: its size for each complete epoch of its source, and
    in the last, partial epoch as many words as the target still holds. The document at the border gives a part of its
    words, or with ``whole`` all of them if more than half fit. ``quality`` names a column of weights; without it all
    documents weigh the same. Results depend on doc_id, weight and seed alone, so reruns agree.

    Defined cases: null texts have size 0 and take nothing; a null source is a source of its own, last in order; repeated
    rows are documents of their own; a null doc_id has a key by its text; null or non-positive weights count as very small;
    an empty table gives no rows; other columns are ignored.
    """
    size = size_of(F.col("text"))
    weight = F.col(quality).cast("double") if quality else F.lit(1.0)
    weight = F.greatest(F.coalesce(F.nanvl(weight, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed))).otherwise(F.xxhash64("text", F.lit(seed)))
    # 52 bits of the hash give u in (0, 1].
    u = (F.shiftrightunsigned(own, 12) + 1) / F.lit(float(1 << 52))
    kept = docs.select("doc_id", "source", size.alias("size"), (-F.log(u) / weight).alias("key"))
    # Any rising function of the key serves for slices; by its logarithm they stay small whatever the weights.
    piece = F.floor(F.log(F.greatest("key", F.lit(1e-18))) * SLICES).cast("int")
    keyed = cut(kept.withColumn("slice", piece), "mix-keys")
    sums = cut(keyed.groupBy("source", "slice").agg(F.sum("size").alias("n")), "mix-slices")
    goals = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), share, most)
    goals = goals.withColumnRenamed("source", "source_")
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    steps = sums.select("source", "slice", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    steps = _hot_join(steps, goals, "source").select(F.col("source").alias("source_"), F.col("slice").alias("slice_"), "earlier", "source_size", "target")
    within = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.withColumn("before", F.coalesce(within, F.lit(0)))
    joined = placed.join(steps, placed["source"].eqNullSafe(steps["source_"]) & (placed["slice"] == steps["slice_"]), "left")
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    left = goal - epochs * F.col("source_size") - F.col("earlier") - F.col("before")
    part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole else F.least(F.greatest(left, F.lit(0)), F.col("size"))
    taken = epochs * F.col("size") + F.when(left > 0, part).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, model: Forest | None = None, share: float = SHARE, most: float = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and any others), each as often as the mix takes it, whole documents only.

    With a model, documents weigh by its score. Rows that share a doc_id are taken together, as often as the one that is taken
    most; documents without a word are never taken.
    """
    known = docs.select("doc_id", "text", "source")
    times = mix(weighed(known, model) if model else known, WEIGHT if model else None, share, most, seed, whole=True).where("taken > 0").groupBy("doc_id").agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    times = times.withColumnRenamed("doc_id", "taken_id")
    joined = docs.join(times, docs["doc_id"].eqNullSafe(times["taken_id"]))
    return joined.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time")).drop("_time")


def weighed(docs: DataFrame, model: Forest) -> DataFrame:
    """``docs`` and the weight of each document, which is its quality score."""
    return score_documents(docs, model, WEIGHT)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = weighed(docs.select("doc_id", "text", "source"), fitted(docs, read(spark, sf_dir, "labels")))
    return mix(scored, WEIGHT).select("doc_id", "size", "source_size", "target", "taken")
