"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(app: str = "namewright", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster use the session that the submitter made."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Bytes of one Arrow batch between the JVM and a Python worker. Whole texts can be long, and Spark's own bound of 64 MB for
#: each task and direction is too much beside a small executor's heap.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where only the driver's sys.path has it, and bound Arrow batches by bytes.

    On a cluster the package comes with ``--py-files``; the added path is then simply absent.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a local default is set.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isEmpty():
            spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints")
            got = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = got.get()
    return set_dir.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path for a written table or for files, inside the shared folder."""
    return f"{shared_dir(spark)}/namewright/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written folder, through Hadoop's file system of its scheme."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
