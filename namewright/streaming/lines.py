"""The matching operators on streams: an addition to the batch operators, with the same functions.

Lines arrive as files or any other streaming source; each micro-batch is matched like a batch, and windowed tallies keep
the state that a watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from namewright.operators import cascade
from namewright.operators.matching import IndexShards


def match_stream(lines: DataFrame, index: IndexShards, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Match streaming lines (raw, confidence and any keys) into Parquet under ``folder``.

    Each micro-batch overwrites a partition of its own number, so a batch that runs again after a failure leaves one copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        cascade.match_readings(batch, index).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def status_counts(matched: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Statuses per window of event time; rows later than the watermark are left out and closed windows leave the state."""
    return matched.withWatermark(time, late).groupBy(F.window(time, width), "status").agg(F.count("*").alias("n"))
