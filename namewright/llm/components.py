"""Connected components of a graph that is only ever held as a distributed table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.session import new_folder, remove

MAX_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star operation over pairs (a, b): the larger (or all smaller) neighbours of each a go to its least one."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")


def _settled(pairs: DataFrame) -> bool:
    """Whether the pairs (a, b) are stars already: each a has one b, and no b is an a."""
    n, nodes = pairs.agg(F.count("*"), F.count_distinct("a")).first()
    return n == nodes and pairs.join(pairs.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (two long columns a, b); component is the least node reachable.

    Alternating large-star and small-star operations: every round is two aggregations by key and two joins, which Spark
    can split where a node has very many neighbours, and each round's edges are written to the shared folder. The number
    of rounds grows with the logarithm of the largest component; edges that are stars already need none. Loops and
    repeated edges are allowed; an empty table gives an empty result; null ends are dropped.
    """
    spark = edges.sparkSession
    pairs = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = new_folder(spark, "edges")
    pairs.write.parquet(path)
    for _ in range(MAX_ROUNDS):
        now = spark.read.schema("a long, b long").parquet(path)
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        large = _star(_both_ways(now), large=True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        after = new_folder(spark, "edges")
        _star(large, large=False).distinct().write.parquet(after)
        remove(spark, path)
        path = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
