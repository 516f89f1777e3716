"""What the training-data operators share: table reading, Arrow maps and small hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from namewright.session import new_folder, remove

#: The white space of the contracts, `[\x20\x09-\x0D]`; it is also what bytes.split() splits at.
SPACES = " \t\n\x0b\x0c\r"

#: The columns that a filtering stage of the pipeline passes on.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


class Cuts:
    """Tables that one operator writes into the shared folder to cut lineage; each can go once what it led to is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        self.paths[what] = path = new_folder(self.spark, what)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            remove(self.spark, self.paths.pop(name))

    def keep(self, name: str) -> None:
        """Leave this table in place: the operator's result reads it."""
        self.paths.pop(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch; batches for which it gives None yield nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch one at a time, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    for value in column:
        yield value.as_py() or ""


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
