"""Embedding near-dedup by spherical-cap filters.

Filter directions are random product codes: the dimensions, after a random rotation, are cut into blocks with a small random code
each, and every combination of one codeword per block is a filter. List-decoding gives a vector all filters whose inner
product with it exceeds the cap height: codewords are sorted by their product in each block, and only combinations that
can still exceed it are visited. Vectors near each other exceed mostly the same filters. They are joined on (label,
filter), and their cosine is verified in double precision.

A pair that shares several filters counts in the least of them only, so links are counted without listing pairs; what
is emitted are the counts of each vector and a spanning forest of each bucket's links. Buckets with very many vectors are
split into blocks, each pair of blocks being a task of its own. Equal vectors are merged first and carry their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import read
from namewright.llm.components import components
from namewright.session import cut

LEAST_COSINE = 0.98
CODE = 96
#: The cap height in standard deviations of a random vector's product, and how many best filters a vector has at least.
HEIGHT = 2.9
LEAST_FILTERS = 8
BLOCK = 1024
SEED = 5


@dataclass
class ProductCode:
    """Two blocks of ``size`` random codewords over ``width`` dimensions."""

    width: int
    size: int = CODE
    height: float = HEIGHT
    least: int = LEAST_FILTERS
    seed: int = SEED

    def __post_init__(self):
        rng = np.random.default_rng([self.seed, self.width])
        self.rotation = np.linalg.qr(rng.normal(size=(self.width, self.width)))[0]
        halves = (self.width + 1) // 2, self.width // 2
        self.codes = [self._unit(rng.normal(size=(self.size, max(h, 1)))) for h in halves]
        self.halves = halves

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """The sorted filter numbers of each unit vector."""
        turned = unit @ self.rotation
        one = turned[:, : self.halves[0]] @ self.codes[0].T
        two = turned[:, self.halves[0] :] @ self.codes[1].T if self.halves[1] else np.zeros((len(unit), self.size))
        cap = self.height * np.sqrt(2.0 / self.width)
        out = []
        for a, b in zip(one, two, strict=True):
            rows = np.flatnonzero(a >= cap - b.max())
            grid = a[rows, None] + b
            i, j = np.nonzero(grid >= cap)
            if len(i) < self.least:
                total = (a[:, None] + b).ravel()
                best = np.argpartition(-total, self.least - 1)[: self.least]
                out.append(np.sort(best).astype(np.int32))
            else:
                out.append((rows[i] * self.size + j).astype(np.int32))
        return out


def normal(vector: list[float | None] | None) -> np.ndarray | None:
    """The unit vector in double precision, or None for a vector that links with nothing."""
    if not vector or any(v is None for v in vector):
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    scale = np.abs(x).max()
    if scale == 0:
        return None
    x = x / scale
    return x / np.linalg.norm(x)


# --- buckets ----------------------------------------------------------------------------------------------------


def _bucket(number: int, ids: np.ndarray, x: np.ndarray, weight: np.ndarray, lists: list[np.ndarray], side: np.ndarray, limit: float) -> list[tuple[int, int, int]]:
    """(id, links, other id or id) rows of one bucket (or pair of blocks): its own links, and a forest of them."""
    counts, forest = np.zeros(len(ids), np.int64), []
    component = np.arange(len(ids))
    crossed = bool(side.any())
    rows = np.flatnonzero(side == 0)
    cols = np.flatnonzero(side == 1) if crossed else rows
    # Which other filters before this one each vector has: a pair that shares one of them counts there.
    smaller = [f[f < number] for f in lists]
    values, place = np.unique(np.concatenate([*smaller, np.zeros(0, np.int32)]), return_inverse=True)
    has = np.zeros((len(ids), len(values)), np.float32)
    has[np.repeat(np.arange(len(ids)), [len(f) for f in smaller]), place] = 1
    for lo in range(0, len(rows), 256):
        part = rows[lo : lo + 256]
        near = x[part] @ x[cols].T >= limit
        if not crossed:
            near &= cols[None, :] > part[:, None]
        if not near.any():
            continue
        near &= has[part] @ has[cols].T == 0
        counts[part] += near @ weight[cols]
        counts[cols] += weight[part] @ near
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            here, others = part[k], cols[near[k]]
            labels, first = np.unique(component[others], return_index=True)
            new = labels != component[here]
            if new.any():
                forest += [(int(ids[here]), 0, int(ids[o])) for o in others[first[new]]]
                component[np.isin(component, labels)] = component[here]
    hit = np.flatnonzero(counts)
    return [(int(ids[k]), int(counts[k]), int(ids[k])) for k in hit] + forest


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the keys."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        differs = np.zeros(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            differs |= c != c[-1]
        last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held


def _units(raw: bytes, n: int, width: int) -> np.ndarray:
    """Unit vectors in double precision from vectors as they were given (float or double)."""
    x = np.frombuffer(raw, f"<f{len(raw) // (n * width)}").reshape(n, width).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _link(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    keys = ["label", "width", "filter", "x", "y"]
    for table in _groups(batches, keys):
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.append(np.flatnonzero(new), table.num_rows)
        ids, weight, side = (table.column(k).to_numpy() for k in ("id", "weight", "side"))
        vectors, lists = (table.column(k).combine_chunks() for k in ("vector", "filters"))
        out: list[tuple[int, int, int]] = []
        for a, b in zip(starts, starts[1:], strict=False):
            if b - a < 2:
                continue
            x = _units(b"".join(v.as_py() for v in vectors[a:b]), b - a, int(columns[1][a]))
            own = [np.frombuffer(v.as_py(), np.int32) for v in lists[a:b]]
            out += _bucket(int(columns[2][a]), ids[a:b], x, weight[a:b], own, side[a:b], limit)
        if out:
            a, n, b = zip(*out, strict=True)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], names=["a", "n", "b"])


# --- DataFrame operators ----------------------------------------------------------------------------------------


def _decode(vectors: DataFrame) -> DataFrame:
    """(id, label, weight, width, vector, filters, filter) of distinct vectors (id, label, weight, embedding)."""

    def run(batches):
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            given = batch.column(3).to_pylist()
            units = [normal(v) for v in given]
            kind = np.dtype("<f4" if batch.column(3).type.value_type == pa.float32() else "<f8")
            width = np.array([0 if u is None else len(u) for u in units])
            lists: list[bytes | None] = [None] * len(units)
            for w in np.unique(width[width > 0]):
                at = np.flatnonzero(width == w)
                code = codes.setdefault(int(w), ProductCode(int(w)))
                for k, f in zip(at.tolist(), code.filters(np.stack([units[k] for k in at])), strict=True):
                    lists[k] = f.tobytes()
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(width, pa.int32()), pa.array([None if u is None else np.array(v, kind).tobytes() for u, v in zip(units, given, strict=True)], pa.binary()), pa.array(lists, pa.binary()), pa.array([[] if f is None else np.frombuffer(f, np.int32).tolist() for f in lists], pa.list_(pa.int32()))],
                names=["id", "label", "weight", "width", "vector", "filters", "filter"],
            )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("id", "label", "weight", "embedding").mapInArrow(run, f"id long, label {kind}, weight long, width int, vector binary, filters binary, filter array<int>")


def cap_links(vectors: DataFrame, limit: float = LEAST_COSINE) -> DataFrame:
    """(a, n, b) rows for distinct vectors: n links of a where a = b, else an edge of a bucket's spanning forest."""
    decoded = cut(_decode(vectors), "filters")
    keyed = decoded.select("id", "label", "width", F.explode("filter").alias("filter"))
    large = keyed.groupBy("label", "width", "filter").count().where(F.col("count") > 1)
    # Buckets of one vector have no pair and are left out before the vectors are sent.
    sizes = large.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    met = keyed.join(sizes, ["label", "width", "filter"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = met.select("id", "label", "width", "filter", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sides = dealt.select("id", "label", "width", "filter", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    full = sides.join(decoded.select("id", "weight", "vector", "filters"), "id")
    keys = ["label", "width", "filter", "x", "y"]
    return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _link(batches, limit), "a long, n long, b long")


def near_vectors(vectors: DataFrame, limit: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine is at least ``limit``. Defined cases: null, empty
    or zero vectors, those with null or non-finite components and those of other lengths link with nothing; repeated
    rows are vectors of their own, so equal rows link with each other; a row with a null vec_id takes part, and is a
    component_id only if its whole component has null ids (kept is then null); an empty table gives no rows.
    """
    rows = vectors.select("vec_id", "label", "embedding", F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.to_json(F.struct("embedding"))), 256).alias("h"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    merged = rows.where(usable).groupBy("label", "h").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    # Numbered as written: the written table keeps the numbers if a task runs again.
    merged = cut(merged.withColumn("id", F.monotonically_increasing_id()), "vectors")
    able = F.size("embedding") > 0
    found = cut(cap_links(merged.where(able), limit), "cap-links")
    links = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    joined = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "id")
    # A vector that can link at all also links with its own copies; cosine 1 is checked by the same rule.
    valid = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    alive = able & ~valid & F.exists("embedding", lambda v: v != 0)
    classes = merged.join(links, "id", "left").join(joined, "id", "left").select("label", "h", "id", "least", "weight", alive.alias("alive"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component"))
    classes = cut(classes, "classes")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(least, "component").select(F.col("label").alias("label_"), F.col("h").alias("h_"), "alive", "n", "weight", "component_id")
    out = rows.join(known, (F.col("label") == F.col("label_")) & (F.col("h") == F.col("h_")), "left")
    linked = F.coalesce(F.col("alive"), F.lit(False))
    return out.select(
        "vec_id",
        F.when(linked, F.col("n") + F.col("weight") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
