"""Planning of synthetic test sets: recipes, slots, and the check of what was rendered.

Draws are hashes of the row's own key and a seed, so a plan does not depend on partitions or on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namewright.operators.layout import C4_COLUMNS, C6_COLUMNS, CARDS

#: The share of each category among slots, and of levels and kinds among images.
MIX = {"en_old": 0.14, "en_modern": 0.38, "en_special": 0.09, "en_multiface": 0.09, "pt": 0.25, "other": 0.04, "en_split": 0.01}
C6_SHARE, EASY_SHARE, HARD_SHARE, PARTIAL_SHARE, RETAKE_SHARE, WRONG_SHARE, TWO_SHARE = 1 / 3, 0.25, 0.25, 0.17, 0.05, 0.05, 0.3
CORNER_PX = 4.0


def draw(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def plan_recipes(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n images with config, level, partial (one, two) and negative (occluded_marker, wrong_count), in exact shares.

    Each attribute is dealt by the rank of an independent draw, so the attributes do not go together.
    """
    images = spark.range(n).select(F.col("id").alias("image"))
    rank = lambda what: F.row_number().over(Window.orderBy(draw(seed, F.lit(what), "image"), "image"))
    ranked = images.select("image", rank("config").alias("c"), rank("level").alias("l"), rank("kind").alias("k"))
    share = lambda s, least=0: max(least, int(n * s + 0.5))
    partial, retake, wrong = (share(s, 1) for s in (PARTIAL_SHARE, RETAKE_SHARE, WRONG_SHARE))
    kind = F.when(F.col("k") <= partial, F.when(draw(seed, F.lit("two"), "image") < TWO_SHARE, "two").otherwise("one"))
    negative = F.when(F.col("k").between(partial + 1, partial + retake), "occluded_marker").when(F.col("k").between(partial + retake + 1, partial + retake + wrong), "wrong_count")
    easy, hard = share(EASY_SHARE), share(HARD_SHARE)
    return ranked.select("image", F.when(F.col("c") <= share(C6_SHARE), "C6").otherwise("C4").alias("config"), F.when(F.col("l") <= easy, "easy").when(F.col("l") <= easy + hard, "hard").otherwise("normal").alias("level"), kind.alias("partial"), negative.alias("negative"))


def plan_columns(recipes: DataFrame, seed: int) -> DataFrame:
    """A row per column: stop_card, n_cards, expect_status of the photo and of the column, and hidden marker ids."""
    n = F.when(F.col("config") == "C6", C6_COLUMNS).otherwise(C4_COLUMNS)
    cols = recipes.withColumn("n_columns", n).withColumn("column", F.explode(F.sequence(F.lit(1), n)))
    pick = F.floor(draw(seed, F.lit("column"), "image") * F.col("n_columns")) + 1
    short = F.floor(draw(seed, F.lit("cards"), "image") * 17).cast("int") + 1
    from_end = F.col("n_columns") - F.col("column")
    hit = F.col("column") == pick
    cards = (
        F.when((F.col("partial") == "one") & (from_end == 0), short)
        .when((F.col("partial") == "two") & (from_end == 1), short)
        .when((F.col("partial") == "two") & (from_end == 0), 0)
        .when((F.col("negative") == "wrong_count") & hit, CARDS - 1)
        .otherwise(CARDS)
    )
    which = F.floor(draw(seed, F.lit("which"), "image") * 3)
    left, right = 2 * (F.col("column") - 1), 2 * (F.col("column") - 1) + 1
    hidden = F.when((F.col("negative") == "occluded_marker") & hit, F.when(which == 0, F.array(left)).when(which == 1, F.array(right)).otherwise(F.array(left, right))).otherwise(F.array().cast("array<int>"))
    stop = ((F.col("partial") == "one") & (from_end == 0)) | ((F.col("partial") == "two") & (from_end <= 1))
    return cols.select(
        "image", "config", "level", "column", F.coalesce(stop, F.lit(False)).alias("stop_card"), cards.alias("n_cards"), hidden.alias("hidden"),
        F.when(F.col("negative") == "occluded_marker", "retake").otherwise("ok").alias("expect_status"),
        F.when((F.col("negative") == "wrong_count") & hit, "error").alias("expect_column_status"),
    )


def plan_slots(columns: DataFrame, pool: DataFrame, seed: int, mix: dict[str, float] | None = None) -> DataFrame:
    """A row per slot with a category by the mix and a card of that category, drawn from ``pool`` (category, card and any others).

    Cards are numbered within their category; a slot's draw picks a number, and the join is on (category, number).
    """
    mix = mix or MIX
    total, upto, category = sum(mix.values()), 0.0, F.lit(None).cast("string")
    u = draw(seed, F.lit("category"), "image", "column", "slot")
    for name, share in reversed(list(mix.items())):
        start = (total - upto - share) / total
        category = F.when(u >= start, name) if upto == 0 else F.when((u >= start) & category.isNull(), name).otherwise(category)
        upto += share
    slots = columns.where("n_cards > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("n_cards"))).alias("slot")).withColumn("category", F.coalesce(category, F.lit(next(iter(mix)))))
    numbered = pool.withColumn("_number", F.row_number().over(Window.partitionBy("category").orderBy("card")) - 1)
    counts = pool.groupBy("category").agg(F.count("*").alias("_cards"))
    wanted = slots.join(F.broadcast(counts), "category").withColumn("_number", F.floor(draw(seed, F.lit("card"), "image", "column", "slot") * F.col("_cards")).cast("int"))
    return wanted.join(numbered, ["category", "_number"]).drop("_number", "_cards").withColumn("tags", F.when(F.col("category") == "en_split", F.array(F.lit("split_sideways"))))


def verify(expected: DataFrame, found: DataFrame, stop_id: int = 40) -> DataFrame:
    """Rendered photos against what a detector finds: (image, missing, leaked, extra, stops_ok, ok).

    expected: image, ids (header ids to be seen), hidden, n_stops; found: image, id, error_px (of its corners).
    """
    seen = found.groupBy("image").agg(F.collect_set(F.when(F.col("id") != stop_id, F.col("id"))).alias("ids_seen"), F.count_if(F.col("id") == stop_id).alias("stops_seen"), F.max("error_px").alias("worst"))
    joined = expected.join(seen, "image", "left").withColumn("ids_seen", F.coalesce("ids_seen", F.array().cast("array<int>")))
    missing, leaked = F.array_except("ids", "ids_seen"), F.array_intersect("hidden", "ids_seen")
    extra = F.array_except(F.array_except("ids_seen", "ids"), "hidden")
    stops = F.coalesce("stops_seen", F.lit(0)) == F.col("n_stops")
    ok = (F.size(missing) == 0) & (F.size(leaked) == 0) & (F.size(extra) == 0) & stops & (F.coalesce("worst", F.lit(0.0)) <= CORNER_PX)
    return joined.select("image", F.array_sort(missing).alias("missing"), F.array_sort(leaked).alias("leaked"), F.array_sort(extra).alias("extra"), stops.alias("stops_ok"), ok.alias("ok"))
