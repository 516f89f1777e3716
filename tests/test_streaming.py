from __future__ import annotations

from pyspark.sql import functions as F

from namewright.operators import cascade, matching
from namewright.streaming.lines import match_stream, status_counts


def test_stream_equals_batch(spark, tmp_path):
    index = matching.shards(spark.createDataFrame([("shock", "Shock", "i1", "en", 0), ("lightning bolt", "Lightning Bolt", "i2", "en", 1)], matching.INDEX_SCHEMA))
    schema = "i long, raw string, confidence double"
    lines = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(["Shock", "Lightning Bolt 3", "x", "12", "Shock 2R"])], schema)
    lines.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    match_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("i", "status", "key").collect()
    want = cascade.match_readings(lines, index).select("i", "status", "key").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:05", "auto"), ("2024-01-01 00:00:50", "auto"), ("2024-01-01 00:01:10", "review")], "t string, status string").select(F.to_timestamp("t").alias("t"), "status")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = status_counts(stream, "t", "1 minute", "5 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.status, r.n) for r in spark.table("windows").collect()) == [("auto", 2), ("review", 1)]
