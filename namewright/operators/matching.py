"""Entity resolution of text lines against a name index.

An index is a table of (key, name, oracle_id, lang, entry_idx): several keys may name one entity (oracle_id), and entry_idx is
the file order that breaks ties. A query's score for an entity is its best key's; the three best entities are its candidates,
and a strict rule accepts the first, sends the line to review, or calls it empty.

The query-by-key scoring runs in an Arrow-batched kernel over a broadcast shard of the index. Shards hold whole entities and
a bounded number of keys; an index of more keys has more shards, each with a pass of its own, whose candidates are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.functions.similarity import KeyMatrix, published_score
from namewright.functions.text import clean, has_letter, normalize
from namewright.session import cut

#: Fixed values of the accept rule.
ACCEPT_SCORE, ACCEPT_LEAD, SHORT_KEY_CHARS, SHORT_KEY_SCORE, EPSILON = 90.0, 5.0, 6, 95.0, 1e-6
CANDIDATES = 3
#: Keys of one broadcast shard: about 100 MB with key matrix, names and ids.
SHARD_KEYS = 200_000

CANDIDATE = "struct<name:string,oracle_id:string,lang:string,key:string,score:double>"
INDEX_SCHEMA = "key string, name string, oracle_id string, lang string, entry_idx long"


class IndexShard:
    """The keys of some entities, in entity order and then file order."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("oracle_id", "ascending"), ("entry_idx", "ascending")])
        self.keys, self.names, self.ids, self.langs = (rows.column(c).to_pylist() for c in ("key", "name", "oracle_id", "lang"))
        self.matrix = KeyMatrix(self.keys)
        ids = np.array(self.ids, object)
        self.starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
        order = np.array([e for e in rows.column("entry_idx").to_pylist()], np.int64)
        self.order = order

    def best(self, query: str, n: int = CANDIDATES) -> list[dict]:
        """The ``n`` best entities: by score, then id; of an entity the best key, then the earliest entry."""
        if not self.keys:
            return []
        ratios = self.matrix.ratio(query)
        top = np.maximum.reduceat(ratios, self.starts)
        picks = np.lexsort((np.arange(len(top)), -top))[:n]
        out = []
        for p in picks.tolist():
            end = self.starts[p + 1] if p + 1 < len(self.starts) else len(ratios)
            at = int(self.starts[p] + ratios[self.starts[p] : end].argmax())
            out.append({"name": self.names[at], "oracle_id": self.ids[at], "lang": self.langs[at], "key": self.keys[at], "score": float(ratios[at])})
        return out


class IndexShards:
    """The shards of an index, of whole entities and bounded size. The driver holds one at a time; a single one is kept."""

    def __init__(self, entries: DataFrame, n: int):
        self.n = n
        part = F.pmod(F.xxhash64("oracle_id"), F.lit(n)).cast("int")
        self.entries = entries if n == 1 else cut(entries.withColumn("_part", part), "index-shards")
        self._only: IndexShard | None = None

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[IndexShard]:
        if self.n > 1:
            for k in range(self.n):
                yield IndexShard(self.entries.where(F.col("_part") == k).drop("_part").toArrow())
        else:
            self._only = self._only or IndexShard(self.entries.toArrow())
            yield self._only


def shards(index: DataFrame, shard_keys: int = SHARD_KEYS) -> IndexShards:
    """The index as shards; one key of an entity is kept once, at its earliest entry, for later ones cannot win."""
    first = index.groupBy("oracle_id", "key").agg(F.min(F.struct("entry_idx", "name", "lang")).alias("f")).select("key", "f.name", "oracle_id", "f.lang", "f.entry_idx")
    return IndexShards(first, max(1, -(-first.count() // shard_keys)))


def top_candidates(queries: DataFrame, index: IndexShards, key: str = "key", n: int = CANDIDATES) -> DataFrame:
    """``queries`` with candidates: the n best entities for column ``key``; empty for a null or empty key.

    Several shards are as many passes, written in between, so that a task holds one shard.
    """
    spark = queries.sparkSession
    kind = pa.list_(pa.struct([("name", pa.string()), ("oracle_id", pa.string()), ("lang", pa.string()), ("key", pa.string()), ("score", pa.float64())]))
    out, names = queries, []
    for k, shard in enumerate(index):
        held = spark.sparkContext.broadcast(shard)

        def score(batches, held=held, k=k):
            for batch in batches:
                keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
                known = {q: held.value.best(q, n) for q in dict.fromkeys(keys) if q}
                yield batch.append_column(f"_top_{k}", pa.array([known.get(q, []) for q in keys], kind))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
        out = out.mapInArrow(score, f"{fields}, _top_{k} array<{CANDIDATE}>")
        names.append(f"_top_{k}")
        if len(index) > 1:
            out = cut(out, "shard-candidates")
            held.unpersist()
    ranked = F.array_sort(F.transform(F.concat(*names), lambda c: F.struct((-c["score"]).alias("less"), c["oracle_id"].alias("id"), c.alias("c"))))
    return out.withColumn("candidates", F.transform(F.slice(ranked, 1, n), lambda r: r["c"])).drop(*names)


def accept(candidates: Column, key: Column) -> Column:
    """auto or review for a line with candidates."""
    best = F.coalesce(F.get(candidates, F.lit(0))["score"], F.lit(0.0))
    lead = best - F.coalesce(F.get(candidates, F.lit(1))["score"], F.lit(0.0))
    good = (best >= ACCEPT_SCORE - EPSILON) & (lead >= ACCEPT_LEAD - EPSILON) & ((F.length(key) > SHORT_KEY_CHARS) | (best >= SHORT_KEY_SCORE - EPSILON))
    return F.when(good, "auto").otherwise("review")


def match_lines(lines: DataFrame, index: IndexShards, text: str = "raw") -> DataFrame:
    """``lines`` with cleaned, key, candidates (scores as published) and status.

    A line without a letter, or whose key is empty, is ``empty`` and has no candidates.
    """
    keyed = lines.withColumn("cleaned", clean(F.col(text))).withColumn("key", normalize(F.col("cleaned")))
    empty = ~F.coalesce(has_letter(F.col(text)), F.lit(False)) | (F.coalesce("key", F.lit("")) == "")
    asked = keyed.withColumn("_key", F.when(~empty, F.col("key")))
    found = top_candidates(asked, index, "_key")
    rounded = F.transform("candidates", lambda c: c.withField("score", published_score(c["score"])))
    status = F.when(F.col("_key").isNull(), "empty").otherwise(accept(F.col("candidates"), F.col("key")))
    return found.withColumn("candidates", rounded).withColumn("status", status).drop("_key")


def score_all(queries: DataFrame, keys: DataFrame, lcs: Column) -> DataFrame:
    """Every query against every key in the JVM, as a cross-check of the kernel; ``lcs`` is an expression over both."""
    return queries.crossJoin(keys).withColumn("lcs", lcs)


def best_per_entity(scored: DataFrame) -> DataFrame:
    """Of scored rows (query, oracle_id, entry_idx, score) the best of each query and entity; ties go to the earliest entry."""
    w = Window.partitionBy("query", "oracle_id").orderBy(F.desc("score"), "entry_idx")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_k(best: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k best entities of each query, with their rank."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "oracle_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
