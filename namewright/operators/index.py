"""Building a name index and the pool of entities that queries are drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.functions.text import normalize
from namewright.session import cut

#: Layouts that are no entries of the index, and those whose secondary names are set into the card.
DROPPED_LAYOUTS = ["token", "double_faced_token", "art_series", "emblem", "planar", "scheme", "vanguard"]
INSET_LAYOUTS = ["adventure", "prepare"]
FOREIGN_LANGUAGE = "Portuguese (Brazil)"
#: What a pool of printings leaves out, and its layouts of several faces.
POOL_DROPPED_LAYOUTS = ["token", "double_faced_token", "emblem", "art_series", "planar", "scheme", "vanguard", "reversible_card", "augment", "host"]
POOL_DROPPED_SET_TYPES = ["token", "memorabilia", "minigame", "alchemy", "vanguard", "planechase", "archenemy", "treasure_chest"]
MULTIFACE_LAYOUTS = ["adventure", "transform", "modal_dfc", "flip", "aftermath", "prepare"]


def index_entries(faces: DataFrame) -> DataFrame:
    """Entries from faces (name, faceName, layout, side, oracle_id, foreign: array<struct<language,name,faceName>>).

    The full name is always an entry, a face's own name too unless the face is a secondary one set into the card; names in the
    foreign language follow. Names are trimmed, equal entries merged, and the order of (lang, key, oracle_id, name) numbers them.
    """
    own = faces.where((F.coalesce("oracle_id", F.lit("")) != "") & ~F.coalesce(F.col("layout").isin(DROPPED_LAYOUTS), F.lit(False)))
    inset = F.coalesce(F.col("layout").isin(INSET_LAYOUTS) & (F.col("side") != "a"), F.lit(False))
    pair = lambda lang, name, face: F.array(F.struct(F.lit(lang).alias("lang"), name.alias("name")), F.struct(F.lit(lang).alias("lang"), F.when(~inset, face).alias("name")))
    listed = F.coalesce("foreign", F.array().cast(faces.schema["foreign"].dataType))
    foreign = F.flatten(F.transform(F.filter(listed, lambda f: f["language"] == FOREIGN_LANGUAGE), lambda f: pair("pt", f["name"], f["faceName"])))
    named = own.select("oracle_id", F.explode(F.concat(pair("en", F.col("name"), F.col("faceName")), foreign)).alias("e"))
    entries = named.select("oracle_id", "e.lang", F.trim("e.name").alias("name")).where("name <> ''")
    return number_entries(entries.withColumn("key", normalize(F.col("name"))).where("key <> ''"))


def number_entries(entries: DataFrame) -> DataFrame:
    """Distinct (lang, key, oracle_id, name) with entry_idx in that order.

    The order is global, so entries are range-partitioned and numbered by partition and place, not in one task.
    """
    spark = entries.sparkSession
    order = ["lang", "key", "oracle_id", "name"]
    ranged = entries.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = cut(ranged, "entries")
    before, offsets = 0, []
    for r in placed.groupBy("_part").count().orderBy("_part").collect():  # a row per partition
        offsets.append((r["_part"], before))
        before += r["count"]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    bounds = spark.createDataFrame(offsets, "_part int, _before long")
    return placed.join(F.broadcast(bounds), "_part").select("key", "name", "oracle_id", "lang", (F.col("_before") + within).alias("entry_idx"))


def key_entities(index: DataFrame) -> DataFrame:
    """The entities of each key."""
    return index.groupBy("key").agg(F.array_sort(F.collect_set("oracle_id")).alias("oracles"))


def solvable(cards: DataFrame, index: DataFrame) -> DataFrame:
    """Cards (oracle_id, key) whose key names them alone."""
    single = key_entities(index).where("size(oracles) = 1").select("key", F.get("oracles", F.lit(0)).alias("oracle_id"))
    return cards.join(single, ["key", "oracle_id"], "left_semi")


def eligible(card: dict[str, Column], allow_lowres: bool = False) -> Column:
    """Whether a printing (digital, oversized, layout, set_type, image_status, oracle_id, textless) may be in the pool."""
    off = lambda c: ~F.coalesce(c, F.lit(False))
    images = ["highres_scan", "lowres"] if allow_lowres else ["highres_scan"]
    known = F.coalesce(card["image_status"].isin(images), F.lit(False)) & (F.coalesce(card["oracle_id"], F.lit("")) != "")
    kind = off(card["layout"].isin(POOL_DROPPED_LAYOUTS)) & off(card["set_type"].isin(POOL_DROPPED_SET_TYPES))
    return off(card["digital"]) & off(card["oversized"]) & off(card["textless"]) & known & kind


def visible_name(lang: Column, layout: Column, name: Column, printed: Column, face_name: Column, face_printed: Column) -> Column:
    """The name that the front of a printing shows, null where it cannot be known.

    face_name and face_printed are of the first face, null without faces. English printings show the name; others the printed
    one, for which only a split card falls back to the name.
    """
    english = lang == "en"
    split = F.when(english, name).otherwise(F.coalesce(printed, name))
    face = F.when(english, face_name).otherwise(face_printed)
    plain = F.when(english, name).otherwise(printed)
    shown = F.when(F.coalesce(layout == "split", F.lit(False)), split).when(face_name.isNotNull(), face).otherwise(plain)
    return F.when(shown != "", shown)


def english_category(layout: Column, border: Column, effects: Column, frame: Column) -> Column:
    """The pool's category of an English printing, the first rule that holds, else null."""
    special = (border == "borderless") | F.arrays_overlap(effects, F.array(F.lit("showcase"), F.lit("extendedart")))
    return F.when(layout == "split", "en_split").when(layout.isin(MULTIFACE_LAYOUTS), "en_multiface").when(special, "en_special").when(frame.isin("1993", "1997"), "en_old").when(frame.isin("2003", "2015"), "en_modern")


def quota_sample(pool: DataFrame, by: str, key: str, quota: int, seed: str, one_per: str | None = None) -> DataFrame:
    """The first ``quota`` rows of each group in an order drawn from md5 of the key and the seed; ties by key.

    With ``one_per`` each of its values gives one row, the first in that order.
    """
    drawn = pool.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    if one_per:
        w = Window.partitionBy(by, one_per).orderBy("_draw", key)
        drawn = drawn.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    w = Window.partitionBy(by).orderBy("_draw", key)
    return drawn.withColumn("draw_rank", F.row_number().over(w)).where(F.col("draw_rank") <= quota).drop("_draw")
