"""Line dedup by levelled sorted runs of line hashes.

A run is a table bucketed and sorted by line hash (sums so far: documents that hold the line, greatest such doc_id). Each
new batch merge-anti-joins the runs: lines that no run has are its first sightings and carry their doc_id, the others
only add to counts. It then adds its own run at level 0; when a level holds ``fanout`` runs they are merged into one of
the next level. Bucketing makes the anti-joins and the merges sort-merge steps without a shuffle of the runs.

Batches come in descending ranges of doc_id, so a first sighting is the largest doc_id that holds the line.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import SPACES, read
from namewright.session import cut

MIN_KEY_CHARS = 20
MIN_DOCUMENTS = 3
#: Line hashes of one batch, and how many batches there are at least and at most (then batches are larger).
BATCH_LINES = 8_000_000
LEAST_BATCHES, MOST_BATCHES = 3, 64
FANOUT = 2

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: str) -> str:
    """The line without white space at its ends, A-Z lower-cased."""
    stripped = line.strip(SPACES)
    return stripped.lower() if stripped.isascii() else stripped.translate(_LOWER)


def key_hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc_id, h): the distinct 128-bit hashes of the keys of at least ``min_chars`` code points, per row."""

    def run(batches):
        for batch in batches:
            ids, hashes = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if doc_id is None:
                    continue
                keys = {k for k in map(line_key, (text.as_py() or "").split("\n")) if len(k) >= min_chars}
                ids += [doc_id] * len(keys)
                hashes += map(key_hash, keys)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["doc_id", "h"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h binary")


class LineRuns:
    """The levelled runs of one corpus, kept as bucketed tables of the session's warehouse."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        rows.repartition(self.buckets, "h").sortWithinPartitions("h").write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def _tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _merged(self, tables: list[str]) -> DataFrame:
        """The runs merged pairwise: full outer joins of tables that are bucketed and sorted alike."""

        def merge(left: DataFrame, right: DataFrame) -> DataFrame:
            other = right.select("h", F.col("n_docs").alias("n_more"), F.col("last_doc").alias("last_more"))
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))
            return left.join(other, "h", "full").select("h", n.alias("n_docs"), F.greatest("last_doc", "last_more").alias("last_doc"))

        return reduce(merge, (self.spark.table(t) for t in tables))

    def add(self, batch: DataFrame) -> None:
        """Add a batch (doc_id, h), whose doc_ids are all smaller than those before it."""
        own = batch.distinct().groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        fresh, seen = own, None
        for table in self._tables():
            run = self.spark.table(table).select("h", F.lit(True).alias("met"))
            fresh = fresh.join(run.withColumnRenamed("met", f"met_{table}"), "h", "left")
            met = F.coalesce(F.col(f"met_{table}"), F.lit(False))
            seen = met if seen is None else seen | met
        if seen is not None:
            # One pass: rows that the anti-join keeps carry their doc_id, the others just their count.
            fresh = fresh.select("h", "n_docs", F.when(~seen, F.col("last_doc")).alias("last_doc"))
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            tables, self.levels[level] = self.levels[level], []
            self._write(self._merged(tables), level + 1)
            for t in tables:
                self.spark.sql(f"DROP TABLE {t}")
            level += 1

    def repeated(self, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
        """(h, last_doc) of the lines found in at least ``min_documents`` documents."""
        return self._merged(self._tables()).where(F.col("n_docs") >= min_documents).select("h", "last_doc")

    def drop(self) -> None:
        for t in self._tables():
            self.spark.sql(f"DROP TABLE {t}")
        self.levels = []


def _batches(hashes: DataFrame, batches: int | None) -> list[DataFrame]:
    """Ranges of doc_id, greatest first, cut at approximate quantiles of the rows' ids."""
    n = batches or min(MOST_BATCHES, max(LEAST_BATCHES, -(-hashes.count() // BATCH_LINES)))
    shares = [k / n for k in range(1, n)]
    cuts = hashes.agg(F.percentile_approx("doc_id", shares)).first()[0] if shares else None
    edges = [None, *sorted(set(cuts or [])), None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        own = F.lit(True) if low is None else F.col("doc_id") >= low
        out.append(hashes.where(own if high is None else own & (F.col("doc_id") < high)))
    return out[::-1]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS, batches: int | None = None) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_dropped): lines of repeated keys stay only in the largest doc_id that holds them.

    The number of batches follows the number of lines unless given. Defined cases: a null or empty text is one empty line;
    rows of one doc_id count as one document; rows with a null doc_id neither count nor lose lines; ids may be any longs;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    hashes = cut(line_hashes(docs, min_chars), "line-hashes")
    runs = LineRuns(spark)
    if not hashes.isEmpty():
        try:
            for batch in _batches(hashes, batches):
                runs.add(batch)
            repeated = cut(runs.repeated(min_documents), "repeated-lines")
        finally:
            runs.drop()
        lost = hashes.join(repeated, "h").where("doc_id <> last_doc").groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_set("h").alias("lost"))
        joined = docs.select("doc_id", "text").join(lost, F.col("doc_id") == F.col("lost_id"), "left").select("doc_id", "text", "lost")
    else:
        joined = docs.select("doc_id", "text", F.lit(None).cast("array<binary>").alias("lost"))

    def run(batches):
        for batch in batches:
            kept, counts, drops = [], [], []
            for text, lost in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                lines = text.split("\n")
                if lost.is_valid:
                    gone = set(lost.as_py())
                    stay = [x for x in lines if len(k := line_key(x)) < min_chars or key_hash(k) not in gone]
                    text = "\n".join(stay)
                    drops.append(len(lines) - len(stay))
                else:
                    drops.append(0)
                kept.append(text)
                counts.append(len(lines))
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], names=["doc_id", "kept_text", "n_lines", "n_dropped"])

    return joined.mapInArrow(run, "doc_id long, kept_text string, n_lines long, n_dropped long")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), repeated AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.last_doc AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
