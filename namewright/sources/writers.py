"""Writers: result files, the index file, reports and resumable outputs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


def write_results(photos: DataFrame, folder: str, image: str = "image") -> None:
    """One JSON file per photo at <folder>/<base name of image>.json, written by the executors. ``folder`` must be shared by them
    all; of photos with one base name the last written stays."""
    packed = photos.select(F.regexp_extract(image, r"([^/]+)/*$", 1).alias("image"), F.to_json(F.struct(*photos.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))

    def write(rows: Iterator[Row]) -> None:
        fs, root = _open(folder)
        for row in rows:
            path = f"{root}/{row['image']}.json"
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(row["json"].encode())

    packed.foreachPartition(write)


def index_lines(index: DataFrame, source: str) -> Iterator[str]:
    """The index file, an entry per line, in entry order; entries stream through the driver partition by partition."""
    yield '{"version": 1, "source": ' + json.dumps(source, ensure_ascii=False) + ', "entries": ['
    held = None
    for r in index.select("key", "name", "oracle_id", "lang", "entry_idx").orderBy("entry_idx").toLocalIterator():
        if held is not None:
            yield held + ","
        held = json.dumps({c: r[c] for c in ("key", "name", "oracle_id", "lang")}, ensure_ascii=False)
    if held is not None:
        yield held
    yield "]}"


def write_index(index: DataFrame, path: str, source: str) -> None:
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        out.writelines(line + "\n" for line in index_lines(index, source))


def write_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key ``path`` does not have yet: a run that was broken off goes on where it stopped."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    new = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if there else rows
    before = spark.read.parquet(path).count() if there else 0
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def markdown(report: DataFrame, limit: int = 1000) -> str:
    """A small report as a Markdown table; reports are aggregates, and more than ``limit`` rows are an error."""
    rows = report.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    show = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(report.columns) + " |", "| " + " | ".join("---" for _ in report.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])


def dump_crops(crops: DataFrame, folder: str) -> None:
    """Each crop (image, column, slot, width, height, pixels) as a binary PGM file; errors of single files are ignored."""

    def write(rows: Iterator[Row]) -> None:
        fs, root = _open(folder)
        for r in rows:
            try:
                fs.create_dir(f"{root}/{r['image']}", recursive=True)
                with fs.open_output_stream(f"{root}/{r['image']}/c{r['column']}_s{r['slot']:02d}.pgm") as out:
                    out.write(f"P5 {r['width']} {r['height']} 255\n".encode() + bytes(r["pixels"]))
            except OSError:
                continue

    crops.foreachPartition(write)
