from __future__ import annotations

from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from namewright.functions import kernels as k
from namewright.functions import markers as m
from namewright.operators import layout
from namewright.plans import catalog, photo, scans
from namewright.sources import readers, writers

PX = 4.0


def strip_photo(columns, stops=None, skip=()):
    """A flat photo of strips at PX pixels a millimetre: header markers, dark name lines, and stop cards {column: slot}."""
    image = np.full((int(245 * PX), int((columns * 70 + 10) * PX)), 235, np.uint8)

    def put(marker, x_mm, y_mm, side_mm):
        tile = m.render(marker, cell=int(side_mm * PX / 6), quiet=0)
        x, y = int(x_mm * PX), int(y_mm * PX)
        image[y : y + len(tile), x : x + len(tile)] = tile

    for j in range(1, columns + 1):
        x0 = (j - 1) * 70 + 5
        for side, x in ((0, 6), (1, 46)):
            if (j, side) not in skip:
                put(2 * (j - 1) + side, x0 + x, 3.5, 18)
        end = (stops or {}).get(j, 21)
        for slot in range(1, min(end, 21)):
            y = int((25 + 10 * (slot - 1) + 5.4) * PX)
            image[y - 5 : y + 5, int((x0 + 8) * PX) : int((x0 + 30) * PX) : 3] = 30
        if stops and j in stops:
            put(40, x0 + 20, 25 + 10 * (stops[j] - 1) + 3, 30)
    return image


@pytest.fixture(scope="module")
def photos(spark):
    scenes = {"four": strip_photo(4, {2: 6}), "broken": strip_photo(4, {1: 3, 2: 4, 3: 2, 4: 2}, skip={(3, 1)}), "six": strip_photo(6, {j: 3 for j in range(1, 7)})}
    rows = [(name, im.shape[1], im.shape[0], bytearray(k.pixels_of(im))) for name, im in scenes.items()]
    return spark.createDataFrame(rows, "path string, width int, height int, pixels binary")


def test_scan_of_whole_photos(spark, photos):
    index = spark.createDataFrame([("lightning bolt", "Lightning Bolt", "id1", "en", 0), ("shock", "Shock", "id2", "en", 1)], "key string, name string, oracle_id string, lang string, entry_idx long")
    fast = lambda images: [("Lightning Bolt" if im.shape[1] > 100 else "?", 0.9) for im in images]
    got = {r.image: r for r in photo.scan(photos, index, fast).collect()}
    four = got["four"]
    assert (four.config, four.status) == ("C4", "ok")
    assert [(c.column, c.stop_card, c.n_cards, c.status) for c in four.columns] == [(1, False, 20, "ok"), (2, True, 5, "ok"), (3, False, 20, "ok"), (4, False, 20, "ok")]
    assert [s.slot for s in four.columns[1].slots] == [1, 2, 3, 4, 5] and {s.name for c in four.columns for s in c.slots} == {"Lightning Bolt"}
    broken = got["broken"]
    assert broken.status == "retake" and [(c.column, c.status, c.n_cards) for c in broken.columns] == [(1, "ok", 2), (2, "ok", 3), (3, "error", 0), (4, "ok", 1)]
    assert got["six"].config == "C6" and len(got["six"].columns) == 6


def test_accurate_reader_sees_only_doubtful_slots(spark, photos, tmp_path):
    index = spark.createDataFrame([("lightning bolt", "Lightning Bolt", "id1", "en", 0), ("shock", "Shock", "id2", "en", 1)], "key string, name string, oracle_id string, lang string, entry_idx long")
    log = str(tmp_path / "seen")

    def accurate(images):
        with open(log, "a") as f:
            f.write("x" * len(images))
        return [("Shock", 0.8) for _ in images]

    one = photos.where("path = 'four'")
    calls = iter(range(10**9))
    fast = lambda images: [("Lightning Bolt" if next(calls) % 5 else "Lightn", 0.9) for _ in images]
    (row,) = photo.scan(one, index, fast, accurate).collect()
    names = [s.name for c in row.columns for s in c.slots]
    assert len(names) == 65 and names.count("Shock") + names.count("Lightning Bolt") == 65 and 0 < names.count("Shock") < 40
    with open(log) as f:
        assert len(f.read()) == names.count("Shock")


def test_results_are_written_and_read_back(spark, photos, tmp_path):
    index = spark.createDataFrame([("shock", "Shock", "id2", "en", 1)], "key string, name string, oracle_id string, lang string, entry_idx long")
    got = photo.scan(photos.where("path = 'four'"), index, lambda images: [("Shock", 0.5)] * len(images))
    writers.write_results(got, str(tmp_path / "out"))
    back = readers.read_results(spark, str(tmp_path / "out"))
    (row,) = back.collect()
    named = got.withColumn("image", F.lit("file:///some/where/img1.jpg"))
    writers.write_results(named, str(tmp_path / "named"))
    again = readers.results_for(named.select("image"), readers.read_results(spark, str(tmp_path / "named"))).collect()
    assert [(r.image, r.status) for r in again] == [("file:///some/where/img1.jpg", row.status)]
    assert row.image == "four" and row.stem == "four" and len(row.columns) == 4 and row.columns[0].slots[0].name == "Shock"


def test_predict_shift_as_function_and_expression(spark):
    cases = [[], [1.0], [0, 0.5, 1, 9, 2, 2.5, 3], [3.0] * 12, [0, 10, 20, 30, 40], [float(i % 7) for i in range(20)]]
    assert layout.predict_shift([]) == 0.0 and abs(layout.predict_shift(cases[2]) - 3.5) <= 0.3
    df = spark.createDataFrame([([float(x) for x in c[-8:]],) for c in cases], "o array<double>")
    got = [r[0] for r in df.select(layout.predicted_shift(F.col("o"))).collect()]
    assert got == pytest.approx([layout.predict_shift(c) for c in cases])


def test_drift_window_equals_the_function(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(v)) for g in range(3) for i, v in enumerate(rng.normal(0, 2, 40).cumsum())]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    got = {(r.g, r.i): r.shift for r in layout.drift(df, ["g"], ["i"], "v").collect()}
    for g in range(3):
        values = [v for h, _, v in rows if h == g]
        assert [got[g, i] for i in range(40)] == pytest.approx([layout.predict_shift(values[:i]) for i in range(40)])


def test_drift_feedback(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 1.2, 9.0, 1.6, 1.8])], "g int, i int, v double")
    rows = sorted(layout.drift_feedback(df, ["g"], ["i"], "v").collect(), key=lambda r: r.i)
    shift = [r.shift for r in rows]
    assert shift[0] == 0.0 and all(abs(r.offset - r.shift) <= 2.5 + 1e-9 for r in rows) and rows[2].offset < 9.0


def test_drift_feedback_equals_its_sql_where_an_offset_lies_at_the_edge(spark, tmp_path):
    # The first user's offsets come to lie just at OUTLIER_MM from a median; nulls and a null user as SQL has them.
    seen = {1: [11.28, 54.2, 144.8, 0.48, 99.86, 92.28, 20.75, 6.52], 2: [3.25, None, 1.0, None, 6.5], None: [1.0, 2.0]}
    rows = [(100 * (user or 0) + i, datetime(2024, 1, 1, i), user, v) for user, values in seen.items() for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = scans.drift_feedback(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.ORACLES["drift_feedback"]).fetchall()) and len(got) == 13


def test_drift_feedback_of_a_group_of_many_batches(spark):
    values = [float(v) for v in np.random.default_rng(2).uniform(0, 8, 300).round(2)]
    df = spark.createDataFrame([(g, i, v) for g in range(2) for i, v in enumerate(values)], "g int, i int, v double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.g, r.i): (r.shift, r.offset) for r in layout.drift_feedback(df, ["g"], ["i"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    offsets = []
    for i, v in enumerate(values):
        shift = layout.predict_shift(offsets)
        offsets.append(min(max(v, shift - 2.5), shift + 2.5))
        assert got[0, i] == got[1, i] == (shift, offsets[-1])


def test_lookup_rejects_ties(spark):
    words = spark.createDataFrame([(0, 0b0000), (1, 0b0111), (2, 0b111000)], "id int, word int")
    codes = spark.createDataFrame([(0,), (0b0001,), (0b0011,), (0b100001,), (255,)], "code int")
    got = {r.code: (r.id, r.errors) for r in layout.dictionary_lookup(codes, words, max_errors=2).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 3: (1, 1), 0b100001: (0, 2), 255: (None, None)}


def test_planned_cards(spark):
    df = spark.createDataFrame([(None,), (1,), (0,), (6,), (21,), (40,)], "s long")
    assert [r[0] for r in df.select(layout.planned_cards(F.col("s"))).collect()] == [20, 0, 0, 5, 20, 20]
