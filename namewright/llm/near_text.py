"""SimHash near-dedup of texts at a similarity of 0.8 or more on five-word shingles.

Every text has a SimHash of its distinct five-word shingles. Texts whose fingerprints differ in at most 3 bits meet by the Golay
keys of ``simhash``; such fingerprints are joined into groups, and the texts of a group are dealt over pairs of blocks where
every pair whose ends are not linked yet is verified by the exact similarity of whole shingle sets. No row per pair is made.

Two texts at a similarity of 0.8 differ in about 15 % of their SimHash bits, beyond what Golay decoding to 3 bits finds. So an
exact pass follows, which loses no pair: if two sets of shingles, in one order for all texts, have a similarity of t, they share
one of the first n - ceil(t n) + 1 of each. The order is by the number of texts in a sample that hold a shingle, and then by hash,
so that common shingles come last; any order is right, it decides only how many candidates there are. Texts join on the shingles
of these prefixes; pairs that the first pass joined, or whose sizes or places in the order rule the similarity out, are left
out, the others verified: those of buckets with few texts one by one, those of larger buckets by groups and blocks as before.

Equal texts (by their words) are merged before both passes. A text goes through Python once for its hash, fingerprint and prefix,
and again only where a candidate needs its whole shingle set. A row is found again by its doc_id and a 64-bit hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import Cuts, arrow_map, texts
from namewright.llm.components import components
from namewright.llm.embedding_dedup import _groups
from namewright.llm.simhash import _shingle_digests, hamming_links, word_list
from namewright.session import cut

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Texts of a bucket of which all pairs are verified one by one, and of a block of a larger one.
ALL_PAIRS, BLOCK = 24, 2048
#: Texts of one block of a group, for few blocks; groups of more than GROUP_BLOCKS blocks have larger ones, up to BLOCK texts.
GROUP_BLOCK, GROUP_BLOCKS = 128, 32
SEED = 42
#: One text in SAMPLE is counted for the order of the shingles; of those in LEAST_COUNT texts or more at most HOT are held.
SAMPLE, LEAST_COUNT, HOT = 16, 3, 200_000
#: Bits of the parity sketch: two sets differ in at least as many elements as their sketches do in bits.
SKETCH = 1024


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """An independent 64-bit hash for each lane, by a finaliser with good avalanche."""
    h = h + np.uint64((lane * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles."""
    return np.unique(np.frombuffer(_shingle_digests(word_list(text), size, SEED), ">u8").astype(np.uint64))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of distinct shingle hashes as a signed 64-bit integer: each bit is the majority's; 0 without shingles."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def _row_hash() -> Column:
    """What tells a document's row from others of its doc_id."""
    return F.xxhash64("text")


def _mark(docs: DataFrame, order, least: float) -> DataFrame:
    """(doc_id, row, h, fp, sketch, prefix): a 128-bit hash of the text's words, its fingerprint, the parity sketch of its
    shingles, and their number and the hashes of its prefix, packed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, fps, sketches, packed = [], [], [], []
        for t in texts(batch):
            own = shingle_hashes(t)
            sketches.append(_sketches([own]).tobytes())
            hashes.append(xxhash.xxh3_128_digest(b" ".join(word_list(t))))
            fps.append(fingerprint(own))
            packed.append(np.concatenate([np.array([len(own)], np.uint64), order.value.prefix(own, least)]).tobytes())
        columns = [batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary()), pa.array(packed, pa.binary())]
        return pa.record_batch(columns, names=["doc_id", "row", "h", "fp", "sketch", "prefix"])

    return arrow_map(docs.select("doc_id", _row_hash().alias("row"), "text"), run, "doc_id long, row long, h binary, fp long, sketch binary, prefix binary")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles): the distinct shingle hashes of each whole text, packed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t).tobytes() for t in texts(batch)]
        return pa.record_batch([batch.column(batch.schema.get_field_index("id")), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return arrow_map(docs.select("id", "text"), run, "id long, shingles binary")


def _similar(one: np.ndarray, two: np.ndarray, least: float) -> bool:
    if min(len(one), len(two)) < least * max(len(one), len(two)) - 1e-9:
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= least * (len(one) + len(two) - both) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets have at least this similarity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for one, two in zip(batch.column(2), batch.column(3), strict=True):
            keep.append(_similar(*(np.frombuffer(v.as_py(), np.uint64) for v in (one, two)), least))
        return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t"), run, "a long, b long")


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(n, SKETCH / 64) parity sketches of sets of hashes."""
    bits = np.stack([np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1 for s in sets]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def _possible(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(possible, distance) of rows and cols: False only for pairs whose sizes or sketches show that they are not similar."""
    sketches, n = _sketches(sets), np.array([len(s) for s in sets])
    distance = np.zeros((len(rows), len(cols)), np.int64)
    for word in range(SKETCH // 64):
        distance += np.bitwise_count(sketches[rows, word][:, None] ^ sketches[cols, word])
    one, two = n[rows][:, None], n[cols][None, :]
    sizes = np.minimum(one, two) >= least * np.maximum(one, two) - 1e-9
    return sizes & (distance <= (one + two) * (1 - least) / (1 + least) + 1e-9), distance


def _likely(pairs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, large) that sizes and sketches do not rule out; those of large buckets pass, since groups check them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [np.frombuffer(b"".join(v[:8] for v in batch.column(c).to_pylist()), np.int64) for c in (3, 5)]
        sketches = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 6)]
        distance = np.bitwise_count(sketches[0] ^ sketches[1]).sum(axis=1, dtype=np.int64)
        keep = distance <= sum(sizes) * (1 - least) / (1 + least) + 1e-9
        keep &= np.minimum(*sizes) >= least * np.maximum(*sizes) - 1e-9
        return batch.filter(pa.array(keep | (batch.column(2).to_numpy() == 1))).select(["a", "b", "large"])

    known = distinct.select("id", F.substring("prefix", 1, 8).alias("n"), "sketch")
    for end in ("a", "b"):
        pairs = pairs.join(known.toDF(end, f"n_{end}", f"sketch_{end}"), end)
    return arrow_map(pairs.select("a", "b", "large", "n_a", "sketch_a", "n_b", "sketch_b"), run, "a long, b long, large long")


def _cross(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (grp, x, y, side, id, label, shingles) sorted by grp, x, y -> links (a, b) between different labels."""
    keys = ["grp", "x", "y"]
    for table in _groups(batches, keys):
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        bounds = np.append(np.flatnonzero(new), table.num_rows)
        ids, side, labels = (table.column(k).to_numpy() for k in ("id", "side", "label"))
        packed = table.column("shingles").combine_chunks()
        out = []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            label = np.unique(labels[lo:hi], return_inverse=True)[1]
            rows = np.flatnonzero(side[lo:hi] == 0)
            cols = np.flatnonzero(side[lo:hi] == 1) if side[lo:hi].any() else rows
            differ = label[rows][:, None] != label[cols][None, :]
            if not differ.any():
                continue
            sets = [np.frombuffer(v.as_py(), np.uint64) for v in packed[lo:hi]]
            possible, distance = _possible(sets, rows, cols, least)
            i, j = np.nonzero(possible & differ)
            closest = np.argsort(distance[i, j], kind="stable")
            for a, b in zip(rows[i[closest]].tolist(), cols[j[closest]].tolist(), strict=True):
                if label[a] != label[b] and _similar(sets[a], sets[b], least):
                    out.append((int(ids[lo + a]), int(ids[lo + b])))
                    label[label == label[b]] = label[a]
        if out:
            a, b = zip(*out, strict=True)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _group_links(groups: DataFrame, labels: DataFrame | None, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs within the groups (id, grp) that have different labels
    (id, label); a text without one is its own."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    blocks = F.least(F.ceil(F.col("n") / GROUP_BLOCK), F.greatest(F.lit(GROUP_BLOCKS), F.ceil(F.col("n") / BLOCK))).cast("int")
    member = groups.join(sizes, "grp").withColumn("blocks", blocks).join(sets, "id")
    member = member.withColumn("label", F.col("id")) if labels is None else member.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = member.select("grp", "id", "label", "shingles", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    x, y, side = F.least("own", "other"), F.greatest("own", "other"), (F.col("own") > F.col("other")).cast("int")
    dealt = met.select("grp", x.alias("x"), y.alias("y"), side.alias("side"), "id", "label", "shingles")
    return dealt.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y").mapInArrow(lambda batches: _cross(batches, least), "a long, b long")


class ShingleOrder:
    """One order of all shingles: by their count in the sample, 0 where it is not held, and then by hash."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        at = np.argsort(shingles)
        self.shingles, self.counts = shingles[at], counts[at]

    def count(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, hashes), len(self.shingles) - 1)
        return np.where(self.shingles[at] == hashes, self.counts[at], 0)

    def prefix(self, hashes: np.ndarray, least: float) -> np.ndarray:
        """The first n - ceil(least n) + 1 of a text's sorted hashes in this order."""
        n = len(hashes)
        return hashes[np.argsort(self.count(hashes), kind="stable")[: n - int(np.ceil(least * n - 1e-9)) + 1]]


def _shingle_order(docs: DataFrame) -> ShingleOrder:
    """The order from the different texts of a sample. The driver holds at most HOT shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_hashes(t).view(np.int64) for t in texts(batch)]
        return pa.record_batch([pa.array(np.concatenate(found))], names=["s"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    counted = cut(arrow_map(sample, run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT), "shingle-counts")
    enough, total = 0, 0
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("m")).collect(), key=lambda r: -r["n"]):
        total += r["m"]
        if total > HOT:
            break
        enough = r["n"]
    rows = counted.where(F.col("n") >= (enough or 1 << 62)).toArrow()
    return ShingleOrder(rows["s"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64))


def _sharing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, xy, id, label, place) sorted by key, xy -> pairs (a, b, large) of different labels that can be similar.

    A large bucket gives all of these pairs if they are few, or else the edges of a spanning forest of them, as large.
    """
    for table in _groups(batches, ["key", "xy"]):
        key, xy, ids, label, place = (table.column(c).to_numpy() for c in ("key", "xy", "id", "label", "place"))
        n, at, side = place >> 32, (place & 0xFFFFFFFF) >> 1, place & 1
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (xy[1:] != xy[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        group = np.repeat(np.arange(len(starts)), sizes)

        def can(i, j, n=n, at=at, label=label):
            """By size, and by what can follow if this shingle is the first that both have."""
            fits = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
            return fits & (label[i] != label[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= (n[i] + n[j]) * least / (1 + least) - 1e-9)

        a, b, large = [], [], []
        few = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= ALL_PAIRS))
        for lag in range(1, ALL_PAIRS):
            i, j = few[:-lag], few[lag:]
            same = group[i] == group[j]
            if not same.any():
                break
            i, j = i[same], j[same]
            # Two blocks of one key: their pairs lie between the sides, those within are of other groups.
            keep = can(i, j) & ((side[i] != side[j]) | (xy[i] >> 32 == (xy[i] & 0xFFFFFFFF)))
            a.append(i[keep])
            b.append(j[keep])
            large.append(np.zeros(keep.sum(), np.int64))
        for g in np.flatnonzero(sizes > ALL_PAIRS):
            here = np.arange(starts[g], starts[g] + sizes[g])
            if (label[here] == label[here[0]]).all():
                continue
            within = xy[here[0]] >> 32 == (xy[here[0]] & 0xFFFFFFFF)
            rows, cols = (here, here) if within else (here[side[here] == 0], here[side[here] == 1])
            tree, pairs, edges, made = np.arange(sizes[g]), [], [], 0
            for r in rows.tolist():
                near = cols[can(r, cols)]
                if within:
                    near = near[near > r]
                if not len(near):
                    continue
                made += len(near)
                if made <= 4 * sizes[g]:
                    pairs.append(np.column_stack([np.full(len(near), r), near]))
                roots, first = np.unique(tree[near - starts[g]], return_index=True)
                other = roots != tree[r - starts[g]]
                if other.any():
                    edges.append(np.column_stack([np.full(other.sum(), r), near[first[other]]]))
                    tree[np.isin(tree, roots)] = tree[r - starts[g]]
            if made:
                found = np.concatenate(pairs if made <= 4 * sizes[g] else edges)
                a.append(found[:, 0])
                b.append(found[:, 1])
                large.append(np.full(len(found), int(made > 4 * sizes[g])))
        if a:
            a, b = ids[np.concatenate(a)], ids[np.concatenate(b)]
            out = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b), np.concatenate(large)]), axis=0)
            if len(out):
                yield pa.record_batch([pa.array(out[:, k]) for k in range(3)], names=["a", "b", "large"])


def _all_candidates(distinct: DataFrame, labels: DataFrame, held, least: float) -> DataFrame:
    """Pairs (a, b, large) of the ids of distinct texts, with every similar pair that ``labels`` (id, label) leave apart."""

    def expand(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [np.frombuffer(v.as_py(), np.uint64) for v in batch.column(2)]
        keys, sizes = np.concatenate([p[1:] for p in packed]), np.array([len(p) - 1 for p in packed])
        row = np.repeat(np.arange(len(packed)), sizes)
        place = np.repeat(np.array([p[0] for p in packed]).astype(np.int64), sizes) << 32 | (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) << 1
        ids, label = (batch.column(k).to_numpy()[row] for k in (0, 1))
        # A key of very many texts, as the sample has it, is dealt over pairs of blocks.
        blocks = np.maximum(1, -(-SAMPLE * held.value.count(keys) // BLOCK))
        own = (_mixed(ids.view(np.uint64), 1) % blocks.astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(keys)), blocks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        own = own[at]
        xy = np.minimum(own, other) << 32 | np.maximum(own, other)
        return pa.record_batch([pa.array(keys.view(np.int64)[at]), pa.array(xy), pa.array(ids[at]), pa.array(label[at]), pa.array(place[at] | (own > other))], names=["key", "xy", "id", "label", "place"])

    known = distinct.select("id", "prefix").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "prefix")
    rows = arrow_map(known, expand, "key long, xy long, id long, label long, place long")
    found = rows.repartition("key", "xy").sortWithinPartitions("key", "xy").mapInArrow(lambda batches: _sharing(batches, least), "a long, b long, large long")
    return found.groupBy("a", "b").agg(F.max("large").alias("large"))


def _golay_groups(distinct: DataFrame) -> DataFrame:
    """(id, grp): distinct texts whose fingerprints equal or are linked, over any number of steps, by at most 3 bits."""
    prints = distinct.select("fp").distinct()
    found = components(hamming_links(prints)).toDF("fp", "grp")
    grouped = distinct.select("id", "fp").join(found, "fp", "left").select("id", F.coalesce("grp", "fp").alias("grp"))
    return grouped.join(grouped.groupBy("grp").count().where("count > 1"), "grp", "left_semi")


def keep_one_of_each_group(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) without near duplicates.

    Texts link at a Jaccard similarity of at least ``least`` of their sets of five-word shingles (words after lower-casing
    A-Z; a shorter text is one shingle); of each connected group the least doc_id stays. Defined cases: null, empty and
    blank texts are copies of one another; of rows with one doc_id and equal words one stays; a null doc_id stays only
    where its whole group has none, and then one row does; an empty table gives no rows; other columns, of whatever name, are
    passed on.
    """
    cuts = Cuts(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(_shingle_order(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    merged = _mark(docs, held, least).groupBy("h").agg(first, *(F.first(c).alias(c) for c in ("fp", "sketch", "prefix")))
    distinct = cuts(merged.withColumn("id", F.monotonically_increasing_id()).drop("h"), "distinct-texts")
    # Whole rows that repeat are rare; only where there are any do joins by row need a step that keeps one.
    repeated = not docs.groupBy("doc_id", _row_hash()).count().where("count > 1").isEmpty()

    def rows_of(source: DataFrame, places: DataFrame, columns: list[str]) -> DataFrame:
        """The rows of ``source`` at places (least and any other columns), with these columns of either."""
        own = source.select(F.struct("*").alias("doc"), "doc_id", _row_hash().alias("row"))
        at = places.select("*", F.col("least.doc_id").alias("at_id"), F.col("least.row").alias("at_row"))
        found = own.join(at, own["doc_id"].eqNullSafe(at["at_id"]) & (own["row"] == at["at_row"]))
        return (found.dropDuplicates(["doc_id", "row"]) if repeated else found).select(*columns)

    def sets_of(ids: DataFrame, what: str) -> DataFrame:
        """Whole shingle sets of some texts. Which ones is written first, so that Spark knows the size of that side."""
        involved = cuts(ids.distinct().join(distinct.select("id", "least"), "id"), f"{what}-ids")
        return cuts(_shingle_sets(rows_of(docs.select("doc_id", "text"), involved, ["id", "doc.text"])), f"{what}-sets")

    groups = cuts(_golay_groups(distinct), "golay-groups")
    links = cuts(_group_links(groups, None, sets_of(groups.select("id"), "golay"), least), "golay-links")
    cuts.drop("golay-sets", "golay-groups")
    labels = cuts(components(links).toDF("id", "label"), "first-labels")
    pairs = cuts(_all_candidates(distinct, labels, held, least), "all-pairs")
    likely = cuts(_likely(pairs, distinct, least), "likely-pairs")
    sets = sets_of(likely.select(F.col("a").alias("id")).union(likely.select("b")), "likely")
    few = _verified(likely.where("large = 0").select("a", "b"), sets, least)
    many = _group_links(components(likely.where("large = 1").select("a", "b")).toDF("id", "grp"), labels, sets, least)
    joined = components(labels.toDF("a", "b").union(few).union(many)).toDF("id", "component")
    labelled = distinct.select("id", "least").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    kept = cuts(labelled.groupBy("component").agg(F.min("least").alias("least")), "kept")
    cuts.keep("kept")
    cuts.drop()
    return rows_of(docs, kept.select("least"), ["doc.*"])
