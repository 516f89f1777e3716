from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewright.functions import geometry as g
from namewright.functions import kernels as k
from namewright.functions import markers as m


def test_downscale_and_integral():
    image = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert k.downscale(image, 2).tolist() == [[image[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].sum() // 4 for x in range(3)] for y in range(2)]
    s = k.integral(image)
    assert s[3, 5] - s[1, 5] - s[3, 2] + s[1, 2] == image[1:3, 2:5].sum()


def test_threshold_finds_a_dark_spot():
    image = np.full((20, 20), 200, np.uint8)
    image[10, 10] = 20
    out = k.adaptive_threshold_inv(image, 3, 7)
    assert out[10, 10] == 255 and out.sum() == 255


def test_identity_warp_and_a_plain_formula():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (9, 11)).astype(np.uint8)
    assert (k.warp_rect(image, np.eye(3), (0, 0, 11, 9), 1) == image).all()
    h = np.array([[1, 0.1, 0.3], [0.02, 0.9, 0.2], [0.001, 0.002, 1]])
    out = k.warp_rect(image, h, (1, 1, 8, 7), 2)
    for v, u in ((0, 0), (5, 7), (11, 13)):
        x, y, z = h @ [1 + (u + 0.5) / 2, 1 + (v + 0.5) / 2, 1]
        value = k.bilinear(image, np.array([x / z - 0.5]), np.array([y / z - 0.5]))[0]
        assert abs(int(out[v, u]) - value) <= 1


def test_clahe_spreads_values():
    image = np.tile(np.arange(100, 130, dtype=np.uint8), (30, 1))
    out = k.clahe(image, 2, 2, 40.0)
    assert int(out.max()) - int(out.min()) > 100


def test_two_means():
    assert k.two_means(np.array([10, 12, 200, 202])) == pytest.approx(106)
    assert k.two_means(np.array([10, 20, 30])) is None


def bars(width, height, ranges):
    image = np.full((height, width), 220, np.uint8)
    for a, b in ranges:
        image[:, a:b:4] = 20
        image[:, a + 1 : b : 4] = 20
    return image


def test_right_trim_cuts_the_cost():
    mm = k.PX_PER_MM
    crop = bars(int(61 * mm), 60, [(int(2 * mm), int(20 * mm)), (int(52 * mm), int(58 * mm))])
    assert 20 * mm <= k.text_right_end(crop) <= 22.5 * mm
    long = bars(int(61 * mm), 60, [(int(2 * mm), int(58 * mm))])
    assert k.text_right_end(long) == long.shape[1]
    assert k.text_right_end(np.full((20, 300), 9, np.uint8)) == 300


def test_text_rows_finds_the_line():
    mm = k.PX_PER_MM
    band = np.full((int(12 * mm), 400), 220, np.uint8)
    y0 = int(6 * mm)
    band[y0 - 12 : y0 + 12, ::6] = 20
    (line, *_) = k.text_rows(band, 25.0, 25.0, 6.4)
    assert line[2] == pytest.approx(31.0, abs=0.8)


def test_variants():
    mm = k.PX_PER_MM
    band = bars(int(61 * mm), int(12 * mm), [(int(2 * mm), int(20 * mm)), (int(52 * mm), int(58 * mm))])
    primary, inverted, untrimmed = (k.crop_variant(band, 25.0, 25.0, 0.0, v)[0] for v in ("primary", "inverted", "untrimmed"))
    assert (inverted == 255 - primary).all() and untrimmed.shape[1] == band.shape[1] > primary.shape[1]
    assert k.crop_variant(bars(int(61 * mm), int(12 * mm), [(24, 700)]), 25.0, 25.0, 0.0, "untrimmed") is None


def test_ctc():
    steps = np.array([[0.1, 0.8, 0.1], [0.1, 0.8, 0.1], [0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8], [0.9, 0.05, 0.05]])
    text, confidence = k.ctc_greedy(steps, ["a", "b"])
    assert text == "aab" and confidence == pytest.approx(0.8)
    assert k.ctc_greedy(np.array([[1.0, 0.0]]), ["a"]) == ("", 0.0)
    assert k.ctc_greedy(np.array([[0.1, 0.45, 0.45]]), ["a", "b"])[0] == "b"


def test_reader_input():
    batch = k.reader_input([np.full((20, 100), 255, np.uint8), np.zeros((10, 10), np.uint8)])
    assert batch.shape == (2, 3, 48, 240) and batch[0].max() == 1.0 and batch[1, 0, 0, 0] == -1.0 and batch[1, 0, 0, 100] == 0.0


def test_homography_round_trip():
    rng = np.random.default_rng(2)
    h = np.array([[1.2, 0.1, 30], [-0.05, 0.9, 12], [1e-4, -2e-4, 1]])
    points = rng.uniform(0, 100, (8, 2))
    found = g.fit_homography(points, g.project(h, points))
    assert np.abs(found - h).max() < 1e-6
    assert g.fit_homography(np.ones((4, 2)), points[:4]) is None and g.fit_homography(points[:3], points[:3]) is None


def test_slot_geometry(spark):
    df = spark.createDataFrame([(1, 28.0), (3, 47.9), (3, 52.1)], "slot int, y double")
    rows = df.select(g.slot_box(F.col("slot")).alias("b"), g.stop_slot(F.col("y")).alias("s")).collect()
    assert tuple(rows[0].b) == (4.5, 25.5, 65.5, 34.5) and [r.s for r in rows] == [1, 3, 3]


def test_words_are_distinct_under_rotation():
    seen = set()
    for marker in range(50):
        bits = np.zeros((6, 6), bool)
        bits[1:-1, 1:-1] = np.array([m.WORDS[marker] >> (15 - i) & 1 for i in range(16)], bool).reshape(4, 4)
        seen |= {m.payload(np.rot90(bits, r)) for r in range(4)}
    assert len(seen) == 200


def test_lookup():
    assert m.lookup(m.WORDS[7]) == (7, 0) and m.lookup(m.WORDS[7] ^ 1) is None and m.lookup(m.WORDS[7] ^ 1, 1) == (7, 1)


def test_detection_of_a_turned_scene():
    scene = np.full((420, 640), 235, np.uint8)
    places = {3: (60, 80), 40: (360, 120), 11: (220, 260)}
    for marker, (x, y) in places.items():
        tile = m.render(marker, cell=14, quiet=1)
        scene[y : y + len(tile), x : x + len(tile)] = tile
    a = np.deg2rad(12)
    to_scene = np.array([[np.cos(a), np.sin(a), -40], [-np.sin(a), np.cos(a), 60], [0, 0, 1]])
    turned = k.warp_rect(scene, to_scene, (0, 0, 640, 420), 1.0)
    found = dict(m.detect(turned))
    assert set(found) == set(places)
    for marker, corners in found.items():
        x, y = places[marker]
        want = np.array([(x + 14, y + 14), (x + 98, y + 14), (x + 98, y + 98), (x + 14, y + 98)], float)
        assert np.abs(g.project(to_scene, corners) - want).max() < 0.8
