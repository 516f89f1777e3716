"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments (21, 21 and 22 bits). Each segment, padded to 23 bits, is decoded
with the perfect binary Golay code: the indices of the codewords nearest to the segment and to its one-bit neighbours
are its one or six keys, so that any two segments at most 2 bits apart have a key in common (the word half way between
them decodes to it). If at most 3 bits of two fingerprints differ, then by the pigeonhole principle either

* some segment i is equal in both, and so is a later choice of partner: with partner i + 1 (cyclic), either that partner
  differs by at most 2 bits, or it takes all 3 errors, and then i + 2 is equal and its partner i is equal too; or
* each segment has just one error, so segment 0 shares a Golay key and one half of segment 1 and one half of 2 is equal.

Joining on (exact segment, Golay key of its partner) and (Golay key of 0, half of 1, half of 2) thus loses no link. The
joined candidates are verified by their Hamming distance. Equal fingerprints are merged before the join, and what is
emitted for a key is a spanning forest of its verified links, never all of its pairs; keys with very many fingerprints
are split into blocks, each pair of blocks being a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import arrow_map, read, texts
from namewright.llm.components import components
from namewright.session import cut

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
#: Fingerprints of one key that one task compares with one another; a key with more is split into blocks of this size.
BLOCK = 2048
#: Bits (start, length) of the segments, and their halves for the case of one error in each.
SEGMENTS = ((0, 21), (21, 21), (42, 22))

# --- Golay code -------------------------------------------------------------------------------------------------

#: Fixed value: a generator polynomial of the perfect binary (23, 12) Golay code.
GENERATOR = 0b101011100011


def _remainder(words: np.ndarray) -> np.ndarray:
    """The 11-bit syndromes of 23-bit words: their remainders on division by the generator polynomial."""
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - 11), 0)
    return r


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of at most 3 bits that it stands for, and by 23-bit word nothing else is needed."""
    one = 1 << np.arange(23, dtype=np.int64)
    i, j, k = (x.ravel() for x in np.meshgrid(np.arange(24), np.arange(24), np.arange(24), indexing="ij"))
    keep = ((i < j) | (j == 23)) & ((j < k) | (k == 23)) & ((i < 23) | (j == 23)) & ((j < 23) | (k == 23))
    none = np.append(one, 0)
    patterns = np.unique(none[i[keep]] | none[j[keep]] | none[k[keep]])
    errors = np.zeros(2048, np.int64)
    errors[_remainder(patterns)] = patterns
    syndromes = np.array([_remainder(np.array([b]))[0] for b in one])
    return errors, syndromes


def golay_keys(words: np.ndarray, width: int) -> np.ndarray:
    """For 23-bit words that use ``width`` low bits: (n, 1 + width) codeword indices, -1 where one repeats the first.

    Column 0 is the index of the nearest codeword, the others those of the words one bit away.
    """
    errors, syndromes = golay_tables()
    words = words.astype(np.int64)
    s = _remainder(words)
    near = (words ^ errors[s]) >> 11
    flips = np.arange(width)
    moved = words[:, None] ^ (1 << flips)
    others = (moved ^ errors[s[:, None] ^ syndromes[flips]]) >> 11
    others[others == near[:, None]] = -1
    # A codeword at distance 4 is met by as many as four flips; keep one.
    others.sort(axis=1)
    others[:, 1:][others[:, 1:] == others[:, :-1]] = -1
    return np.column_stack([near, others])


# --- fingerprints -----------------------------------------------------------------------------------------------


def word_list(text: str) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingle_digests(words: list[bytes], size: int, seed: int) -> bytes:
    """The XXH64 digests (big-endian) of all shingles, repeats included."""
    if len(words) <= size:
        return xxhash.xxh64_digest(b" ".join(words), seed) if words else b""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)])


def fingerprint(text: str, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned integer; 0 if it has no word."""
    digests = _shingle_digests(word_list(text), size, seed)
    if not digests:
        return 0
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[lo : lo + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; fp is the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, size, seed) for t in texts(batch)], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp long")


# --- candidate keys and verification ----------------------------------------------------------------------------


def _segment(fps: np.ndarray, start: int, length: int) -> np.ndarray:
    return (fps >> np.uint64(start) & np.uint64((1 << length) - 1)).astype(np.int64)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys): for each key the place in ``fps`` of its fingerprint. A key has its kind in the top bits."""
    places, keys = [], []
    here = np.arange(len(fps))
    segments = [_segment(fps, *s) for s in SEGMENTS]
    golay = [golay_keys(s, length) for s, (_, length) in zip(segments, SEGMENTS, strict=True)]

    def add(kind: int, codes: np.ndarray, rest: np.ndarray) -> None:
        """rest: what else is in the key, below 2^44."""
        at, column = np.nonzero(codes >= 0)
        places.append(here[at])
        keys.append((np.int64(kind) << 58) | (codes[at, column] << 44) | rest[at])

    for i in range(3):
        add(i, golay[(i + 1) % 3], segments[i])
    for half in range(4):
        x, y = ((s >> 11 if bit else s & 0x7FF) for s, bit in zip(segments[1:], (half & 1, half >> 1), strict=True))
        add(3 + half, golay[0], x << 11 | y)
    return np.concatenate(places), np.concatenate(keys)


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of {(l, r): distance <= limit}, places of ``fps``, without holding all the pairs."""
    parent = {int(i): int(i) for i in np.concatenate([left, right])}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in left.tolist():
        near = right[np.bitwise_count(fps[right] ^ fps[i]) <= limit]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _verify(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, x, y, side, fp) sorted by key, x, y -> links (a, b). A group may go over several batches."""
    held: pa.Table | None = None

    def links(table: pa.Table) -> pa.RecordBatch:
        key, x, y, side = (table.column(c).to_numpy() for c in ("key", "x", "y", "side"))
        fps = table.column("fp").to_numpy().view(np.uint64)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        a, b = [], []
        # Small groups: compare with the next, the one after it, and so on, all groups at once.
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= 32))
        for lag in range(1, 32):
            if len(small) <= lag:
                break
            i, j = small[:-lag], small[lag:]
            same = group[i] == group[j]
            if not same.any():
                break
            i, j = i[same], j[same]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= limit
            a.append(i[near])
            b.append(j[near])
        for g in np.flatnonzero(sizes > 32):
            here = np.arange(starts[g], starts[g] + sizes[g])
            left = here[side[here] == 0]
            right = here[side[here] == 1]
            found = _forest(fps, left, right if len(right) else left, limit)
            if found:
                a.append(np.array([f[0] for f in found]))
                b.append(np.array([f[1] for f in found]))
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        signed = fps.view(np.int64)
        pairs = np.unique(np.column_stack([np.minimum(signed[a], signed[b]), np.maximum(signed[a], signed[b])]), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        cols = [table.column(c).to_numpy() for c in ("key", "x", "y")]
        differs = np.zeros(table.num_rows, bool)
        for c in cols:
            differs |= c != c[-1]
        last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if last:
            yield links(table.slice(0, last))
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield links(held)


def hamming_links(fps: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``fps`` (fp), whose components are those of all links."""
    if limit > MAX_DISTANCE:
        raise ValueError(f"the keys lose no link up to {MAX_DISTANCE} differing bits only")

    def expand(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(0).to_numpy()
        at, keys = fuzzy_keys(values.view(np.uint64))
        return pa.record_batch([pa.array(keys), pa.array(values[at])], names=["key", "fp"])

    keyed = arrow_map(fps.select("fp"), expand, "key long, fp long")
    # Keys of more than BLOCK fingerprints are rare; their fingerprints are dealt over blocks.
    large = keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    sized = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    met = sized.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = met.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    # In order of the fingerprints, so that the forests of different keys have mostly the same links.
    ordered = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "fp")
    return ordered.mapInArrow(lambda batches: _verify(batches, limit), "a long, b long").distinct()


def simhash_components(docs: DataFrame, size: int = SHINGLE_WORDS, limit: int = MAX_DISTANCE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id of those reachable by links.

    Fingerprints link at ``limit`` or fewer differing bits. Defined cases: a null, empty or blank text has fingerprint 0
    and links like any other; a row with a null doc_id links documents but is nobody's component_id unless its whole
    component has null ids; repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    marked = cut(fingerprints(docs, size, seed), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(hamming_links(distinct, limit)).withColumnRenamed("node", "fp")
    labelled = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = cut(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    classes = cut(labelled.join(least, "component").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
