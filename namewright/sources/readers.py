"""Readers: name indexes, dictionaries, results, manifests, card catalogues, line-delimited dumps and photos.

All JSON is read with explicit schemas; gzip is told by the file name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions.kernels import luma, pixels_of

INDEX_FILE = "version int, source string, entries array<struct<key:string,name:string,oracle_id:string,lang:string>>"
RESULT_FILE = (
    "spec_version int, image string, config string, status string, columns array<struct<column:int,status:string,stop_card:boolean,n_cards:int,"
    "slots:array<struct<slot:int,status:string,raw_text:string,name:string,oracle_id:string,lang:string,score:double,"
    "candidates:array<struct<name:string,oracle_id:string,score:double>>>>>>, timing_ms string"
)
SLOT_TRUTH = "struct<slot:int,oracle_id:string,name:string,lang:string,category:string,scryfall_id:string,image_uri:string,printed_lang:string,tags:array<string>,placement:array<double>>"
MANIFEST_FILE = (
    "spec_version int, set string, generator string, seed bigint, pool string, mode string, card_images string, eval_notes map<string,string>, "
    "images map<string,struct<seed:bigint,attempt:int,config:string,level:string,expect_status:string,mode:string,"
    "negative:struct<kind:string,column:int,ids:array<int>>,"
    f"columns:array<struct<column:int,stop_card:boolean,n_cards:int,expect_column_status:string,slots:array<{SLOT_TRUTH}>>>,difficulty:string>>"
)
CATALOGUE_FILE = (
    "meta struct<date:string,version:string>, data map<string,array<struct<name:string,faceName:string,layout:string,side:string,"
    "identifiers:struct<scryfallOracleId:string>,foreignData:array<struct<language:string,name:string,faceName:string>>>>>"
)


def read_name_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, oracle_id, lang, entry_idx) of an index file, whose version must be 1; entry_idx is the file order."""
    whole = spark.read.schema(INDEX_FILE).json(path, multiLine=True)
    versions = [r["version"] for r in whole.select("version").distinct().limit(2).collect()]
    if versions != [1]:
        raise ValueError(f"unsupported index version {versions}")
    return whole.select(F.posexplode("entries").alias("entry_idx", "e")).select("e.*", F.col("entry_idx").cast("long").alias("entry_idx"))


def read_dictionary(spark: SparkSession, path: str) -> list[str]:
    """The letters of a reader, one a line; a line of one space counts, a last empty line does not."""
    text = spark.read.text(path, wholetext=True).first()
    lines = [x.removesuffix("\r") for x in (text[0] if text else "").split("\n")]
    return lines[:-1] if lines and not lines[-1] else lines


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files (a folder or glob) with stem, the file's name without .json."""
    rows = spark.read.schema(RESULT_FILE).json(path, multiLine=True)
    return rows.withColumn("stem", F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1))


def results_for(images: DataFrame, results: DataFrame, image: str = "image") -> DataFrame:
    """Each image with its result: of the file named as the image's base name without its extension or, failing that, with it
    (``img.json`` before ``img.jpg.json``). Images without a result keep null."""
    base = F.regexp_extract(image, r"([^/]+)$", 1)
    wanted = images.withColumn("_stems", F.array_distinct(F.array(F.regexp_replace(base, r"(?<=.)\.[^.]+$", ""), base)))
    asked = wanted.select(image, F.posexplode("_stems").alias("_rank", "stem"))
    kept = [c for c in results.columns if c not in (image, "stem")]
    met = asked.join(results, "stem").groupBy(asked[image]).agg(F.min_by(F.struct(*(results[c] for c in kept)), "_rank").alias("_r"))
    return images.join(met, image, "left").select(*images.columns, *(F.col(f"_r.{c}").alias(f"result_{c}" if c in images.columns else c) for c in kept))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per expected image: set, image and its truth."""
    return spark.read.schema(MANIFEST_FILE).json(path, multiLine=True).select("set", F.explode("images").alias("image", "truth")).select("set", "image", "truth.*")


def manifest_slots(images: DataFrame) -> DataFrame:
    """A row per true slot with the attributes of its image."""
    cols = images.select("image", "config", "level", F.explode("columns").alias("c"))
    return cols.select("image", "config", "level", "c.column", F.explode("c.slots").alias("s")).select("image", "config", "level", "column", "s.*")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Faces of a card catalogue (a map from name to faces), ready for ``index_entries``."""
    faces = spark.read.schema(CATALOGUE_FILE).json(path, multiLine=True).select(F.explode("data").alias("card", "faces")).select(F.explode("faces").alias("f"))
    return faces.select("f.name", "f.faceName", "f.layout", "f.side", F.col("f.identifiers.scryfallOracleId").alias("oracle_id"), F.col("f.foreignData").alias("foreign"))


def read_bulk_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a dump with one per line: array brackets are skipped and a trailing comma is cut."""
    line = F.regexp_replace(F.trim("value"), r",\s*$", "")
    return spark.read.text(path).select(line.alias("value")).where("value LIKE '{%'").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, pixels) in gray, of image files in any format that the JVM decodes; broken files are dropped."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def gray(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                bgr = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
                out.append({"path": row["origin"], "width": row["width"], "height": row["height"], "pixels": pixels_of(luma(bgr))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    return images.mapInArrow(gray, "path string, width int, height int, pixels binary")
