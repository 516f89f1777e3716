"""The whole path from photos to nested results.

photos (path, width, height, pixels) -> markers -> layout -> slot crops -> readings -> matches -> re-reads -> results. Steps that look
at pixels run in Arrow-batched maps; the rest is DataFrame operations. Each pass of a reader is written once, so that Spark
does not run it again for every later use.

A reader is any function of a list of gray images that gives (text, confidence) for each; ``reader_from`` wraps an onnxruntime
model with its dictionary where a model file is at hand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.functions import geometry as g
from namewright.functions import kernels, markers
from namewright.operators import cascade, layout, matching, results
from namewright.session import cut

Reader = Callable[[list[np.ndarray]], list[tuple[str, float]]]

VARIANTS = ["inverted", "second", "untrimmed"]
SLOT_PAD_MM = 1.5
CROP = "image string, column long, slot int, variant int, shift double, width int, height int, pixels binary"
KEYS = ["image", "column", "slot"]


def detect_markers(photos: DataFrame) -> DataFrame:
    """Rows (image, place, id, cx, cy, side, corners) of every marker of each photo."""
    corner = pa.list_(pa.list_(pa.float64()))
    kind = pa.schema([("image", pa.string()), ("place", pa.int32()), ("id", pa.int32()), ("cx", pa.float64()), ("cy", pa.float64()), ("side", pa.float64()), ("corners", corner)])

    def run(batches):
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                for place, (marker, corners) in enumerate(markers.detect(kernels.image_of(p["pixels"], p["width"], p["height"]))):
                    centre = corners.mean(axis=0)
                    side = float(np.hypot(*(np.roll(corners, -1, axis=0) - corners).T).mean())
                    rows.append({"image": p["path"], "place": place, "id": marker, "cx": float(centre[0]), "cy": float(centre[1]), "side": side, "corners": corners.tolist()})
            yield pa.RecordBatch.from_pylist(rows, kind)

    return photos.select("path", "width", "height", "pixels").mapInArrow(run, "image string, place int, id int, cx double, cy double, side double, corners array<array<double>>")


def slot_band(image: np.ndarray, m: np.ndarray, slot: int, shift: float) -> tuple[np.ndarray, float, float]:
    """(band, its top in mm, the card's nominal top) of a slot, moved down by ``shift``."""
    top = g.HEADER_Y + g.SLOT_PITCH * (slot - 1)
    y0, y1 = top + g.SLOT_INSET - SLOT_PAD_MM + shift, top + g.SLOT_PITCH - g.SLOT_INSET + SLOT_PAD_MM + shift
    return kernels.warp_rect(image, m, (g.SLOT_X0, y0, g.SLOT_X1, y1), kernels.PX_PER_MM), y0, top


def slot_crops(photos: DataFrame, plan: DataFrame, params: dict | None = None) -> DataFrame:
    """Primary crops of every readable column's slots: down a column each slot is searched for around the drift predicted from
    those above it, so a column is one sequential scan. A photo's columns are one row, so its pixels are sent once."""
    params = params or {}
    wanted = plan.where("readable").groupBy("image").agg(F.sort_array(F.collect_list(F.struct("column", "n_cards", "m"))).alias("columns"))
    joined = wanted.join(photos.withColumnRenamed("path", "image"), "image")

    def run(batches):
        for batch in batches:
            for p in batch.to_pylist():
                image = kernels.image_of(p["pixels"], p["width"], p["height"])
                for c in p["columns"]:
                    m, offsets, rows = np.array(c["m"]).reshape(3, 3), [], []
                    for slot in range(1, c["n_cards"] + 1):
                        shift = layout.predict_shift(offsets)
                        crop, offset = kernels.crop_variant(*slot_band(image, m, slot, shift), shift, "primary", **params)
                        offsets.append(offset)
                        rows.append({"image": p["image"], "column": c["column"], "slot": slot, "variant": 0, "shift": shift, "width": crop.shape[1], "height": crop.shape[0], "pixels": kernels.pixels_of(crop)})
                    yield pa.RecordBatch.from_pylist(rows, _CROP_SCHEMA)

    return joined.select("image", "columns", "width", "height", "pixels").mapInArrow(run, CROP)


_CROP_SCHEMA = pa.schema([("image", pa.string()), ("column", pa.int64()), ("slot", pa.int32()), ("variant", pa.int32()), ("shift", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])


def variant_crops(photos: DataFrame, plan: DataFrame, crops: DataFrame, open_slots: DataFrame, params: dict | None = None) -> DataFrame:
    """The other crops of the slots that are still open, in one round; variants that do not exist give no row. A photo's slots
    are one row, so its pixels are sent once."""
    params = params or {}
    asked = crops.select(*KEYS, "shift").join(open_slots.select(*KEYS), KEYS, "left_semi")
    slot = F.struct(*KEYS[1:], "shift", "m")
    listed = asked.join(plan.select("image", "column", "m"), ["image", "column"]).groupBy("image").agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    joined = listed.join(photos.withColumnRenamed("path", "image"), "image")

    def run(batches):
        for batch in batches:
            for p in batch.to_pylist():
                image, rows = kernels.image_of(p["pixels"], p["width"], p["height"]), []
                for s in p["slots"]:
                    band = slot_band(image, np.array(s["m"]).reshape(3, 3), s["slot"], s["shift"])
                    for k, variant in enumerate(VARIANTS, 1):
                        found = kernels.crop_variant(*band, s["shift"], variant, **params)
                        if found is not None:
                            crop = found[0]
                            rows.append({"image": p["image"], "column": s["column"], "slot": s["slot"], "variant": k, "shift": s["shift"], "width": crop.shape[1], "height": crop.shape[0], "pixels": kernels.pixels_of(crop)})
                yield pa.RecordBatch.from_pylist(rows, _CROP_SCHEMA)

    return joined.select("image", "slots", "width", "height", "pixels").mapInArrow(run, CROP)


def read_lines(crops: DataFrame, reader: Reader, batch: int = 4) -> DataFrame:
    """(image, column, slot, variant, raw, confidence): crops go to the reader by width, a few at a time."""
    kind = pa.schema([("image", pa.string()), ("column", pa.int64()), ("slot", pa.int32()), ("variant", pa.int32()), ("raw", pa.string()), ("confidence", pa.float64())])

    def run(batches):
        for b in batches:
            rows = sorted(b.to_pylist(), key=lambda r: r["width"] / max(r["height"], 1))
            out = []
            for k in range(0, len(rows), batch):
                part = rows[k : k + batch]
                read = reader([kernels.image_of(r["pixels"], r["width"], r["height"]) for r in part])
                out += [{**{c: r[c] for c in (*KEYS, "variant")}, "raw": t, "confidence": float(c)} for r, (t, c) in zip(part, read, strict=True)]
            yield pa.RecordBatch.from_pylist(out, kind)

    return crops.mapInArrow(run, "image string, column long, slot int, variant int, raw string, confidence double")


def reader_from(model: str, letters: list[str], height: int = 48, max_width: int = 640) -> Reader:
    """A reader over an onnxruntime model (n, 3, height, width) -> (n, steps, classes); one session per Python worker."""
    sessions: dict = {}

    def read(images: list[np.ndarray]) -> list[tuple[str, float]]:
        import onnxruntime

        if model not in sessions:
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            sessions[model] = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        session = sessions[model]
        found = session.run(None, {session.get_inputs()[0].name: kernels.reader_input(images, height, max_width)})[0]
        return [kernels.ctc_greedy(p, letters) for p in found]

    return read


def scan(photos: DataFrame, index: DataFrame, fast: Reader, accurate: Reader | None = None, params: dict | None = None) -> DataFrame:
    """Nested results (spec_version, image, config, status, columns) of gray photos.

    ``fast`` reads every slot; ``accurate``, if given, only those that the fast reading does not settle; then the other crops
    of slots that are still not accepted are read once.
    """
    photos = cut(photos, "photos")
    shards = matching.shards(index)
    found = cut(detect_markers(photos), "markers")
    columns = layout.column_geometry(layout.best_pairs(found))
    names = photos.select(F.col("path").alias("image"))
    config = layout.photo_config(found, columns, names)
    plan = cut(layout.column_plan(config, columns, layout.stop_slots(columns, found)), "plan")
    crops = cut(slot_crops(photos, plan, params), "crops")
    current = cut(cascade.match_readings(read_lines(crops, fast).drop("variant"), shards), "readings")
    if accurate is not None:
        doubt = current.where(~cascade.trusted(F.col("status"), F.col("raw"), F.col("key"), F.col("candidates")))
        again = read_lines(crops.join(doubt.select(*KEYS), KEYS, "left_semi"), accurate).drop("variant")
        current = cut(cascade.reread_untrusted(current, cut(again, "reread-lines"), shards, KEYS), "reread")
    last = accurate or fast
    tried = read_lines(variant_crops(photos, plan, crops, current.where("status <> 'auto'"), params), last)
    current = cut(cascade.fallback(current, cut(tried, "variant-lines"), shards, KEYS), "final")
    slots = results.slot_fields(current).select(*KEYS, "status", F.col("raw").alias("raw_text"), "name", "oracle_id", "lang", "score", "candidates")
    assembled = results.assemble_columns(plan, slots, ["image"])
    unreadable = plan.groupBy("image", "config").agg(F.count_if(~F.col("readable")).alias("unreadable"))
    return results.assemble_photos(assembled, unreadable)
