from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewright.functions import camera as c
from namewright.functions import markers
from namewright.operators import synth


def test_projection_round_trip():
    cam = c.Camera.over((140, 120), 380, 1600, 1200, 1000, tilt=2, direction=40, yaw=1, k1=0.01)
    points = np.array([(10.0, 20.0), (140, 120), (270, 230)])
    flat = cam.undistorted(cam.project(points))
    back = np.linalg.inv(cam.plane()) @ np.column_stack([flat, np.ones(3)]).T
    assert np.abs((back[:2] / back[2]).T - points).max() < 1e-3
    assert cam.project(np.array([(140.0, 120.0)]))[0] == pytest.approx([800, 600])
    assert np.allclose(c.rotation(3, 20, 5) @ c.rotation(3, 20, 5).T, np.eye(3))


def test_photographed_markers_are_found():
    rng = np.random.default_rng(4)
    scene = c.strip_scene([20, 20, 5, 0], [False, False, True, True], 4.0, hidden={1})
    points = np.array([(5.0, 3.5), (285, 3.5), (285, 230), (5, 230)])
    cam = c.sample_camera(rng, (1800, 1500), 400, (145, 120), points, tilt=1.5, yaw=1, decentre=3, k1=0.004)
    photo = c.expose(cam.photograph(scene, 4.0), rng, 0.98, (0.05, -0.05), 0.1, [(300, 300, 60, 0.2)], 0.05, 2)
    found = sorted(m for m, _ in markers.detect(photo))
    assert found == [0, 2, 3, 4, 5, 6, 7, 40, 40]


def test_impossible_camera():
    with pytest.raises(RuntimeError):
        c.sample_camera(np.random.default_rng(0), (100, 100), 100, (0, 0), np.array([(10_000.0, 0.0)]), 1, 1, 1, 0, tries=3)


def test_stamp():
    template = np.zeros((10, 20), bool)
    template[2:5, 3:15] = True
    assert c.stamped(np.where(template, 255, 0), template) and not c.stamped(np.zeros((10, 20)), template)


def test_plan(spark):
    recipes = synth.plan_recipes(spark, 60, 3)
    rows = recipes.collect()
    assert sum(r.config == "C6" for r in rows) == 20 and sum(r.level == "easy" for r in rows) == 15
    assert sum(r.partial is not None for r in rows) == 10 and sum(r.negative == "wrong_count" for r in rows) == 3
    columns = synth.plan_columns(recipes, 3)
    again = synth.plan_columns(synth.plan_recipes(spark, 60, 3).repartition(5), 3)
    assert sorted(map(str, columns.collect())) == sorted(map(str, again.collect()))
    per = {}
    for r in columns.collect():
        per.setdefault(r.image, []).append(r)
    for r in rows:
        own = sorted(per[r.image], key=lambda x: x.column)
        assert len(own) == (6 if r.config == "C6" else 4)
        assert sum(x.stop_card for x in own) == {"one": 1, "two": 2, None: 0}[r.partial]
        assert (r.negative == "occluded_marker") == any(x.hidden for x in own) == (own[0].expect_status == "retake")
    pool = spark.createDataFrame([(k, f"{k}-{i}") for k in synth.MIX for i in range(7)], "category string, card string")
    slots = synth.plan_slots(columns, pool, 3)
    n = slots.count()
    assert n == columns.agg(F.sum("n_cards")).first()[0]
    share = {r.category: r["count"] / n for r in slots.groupBy("category").count().collect()}
    assert all(abs(share.get(k, 0) - v) < 0.03 for k, v in synth.MIX.items())


def test_verify(spark):
    expected = spark.createDataFrame([("a", [0, 1], [2], 1), ("b", [0, 1], [2], 0), ("c", [0], [], 0)], "image string, ids array<int>, hidden array<int>, n_stops int")
    found = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("a", 40, 0.5), ("b", 0, 1.0), ("b", 2, 1.0), ("b", 9, 1.0), ("c", 0, 5.0)], "image string, id int, error_px double")
    rows = {r.image: r for r in synth.verify(expected, found).collect()}
    assert rows["a"].ok and (rows["b"].missing, rows["b"].leaked, rows["b"].extra, rows["b"].ok) == ([1], [2], [9], False) and not rows["c"].ok
