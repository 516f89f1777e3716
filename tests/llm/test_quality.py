from __future__ import annotations

import zlib

import numpy as np
import pytest

from namewright.llm import quality


def test_forest_walk_equals_a_node_by_node_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(quality.FEATURES)))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    model = quality.fit(x, y)

    def one(row):
        total = model.base
        for root in model.root:
            at = int(root)
            while not (model.left[at] == at):
                at = int(model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at])
            total += model.value[at]
        return 1 / (1 + np.exp(-total))

    got = model.score(x)
    assert got[:60] == pytest.approx([one(r) for r in x[:60]])
    assert ((got >= 0.5) == y).mean() > 0.95


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held) > 50


def test_held_out_labels_are_never_learned(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = quality.fold(F.col("doc_id"), 3) == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "words here", 0.1), (3, "x" * 300_000, 0.1), (4, "a b c", 0.1), (4, "a b c", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, score double")
    rows = quality.quality_scores(docs, none).collect()
    assert len(rows) == 6 and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    same = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (4, None)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, same).collect()}
    assert scores[1] == scores[2] and 0 <= scores[3] <= 1
    assert quality.quality_scores(docs.limit(0), none).count() == 0
