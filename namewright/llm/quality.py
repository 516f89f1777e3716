"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training runs in numpy on a bounded sample of labelled rows (``MAX_TRAINING_ROWS``, the rows of least hash); trees grow leaf
by leaf on quantile bins. A fitted model is a few flat arrays, so scoring a batch is one vectorised walk: all rows of all
trees go down a level at a time.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import arrow_map, read, texts
from namewright.session import cut

MAX_TRAINING_ROWS = 40_000
TREES, LEAVES, RATE, BINS, LEAST_ROWS, RIDGE = 120, 16, 0.1, 64, 20, 1.0

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "long_words", "short_words", "distinct_words",
    "top_word", "symbols", "digits", "upper", "non_ascii", "stops", "commas", "lines_per_word", "distinct_lines",
    "line_length", "bars", "marks_per_word", "common_words", "double_spaces", "odd_symbols", "repeated_pairs", "packed",
]

_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SPACES = b" \t\n\x0b\x0c\r"
_PLAIN = _LETTERS + _DIGITS + _SPACES + b".,"
_ODD = b"#$%&*<>{}[]|\\^~@=+_/"
#: Very common words of a few languages.
COMMON = frozenset(w.encode() for w in "the of and to in is that it for was with as on be at by this are from or an de la le les et en un une des du que est dans pour par el los las y se del con una por der die das und ist von zu den mit sich auf für ein eine dem".split())


def statistics(text: str) -> list[float]:
    """The features of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    w = len(words)
    lengths = np.fromiter(map(len, words), np.float64, w)
    lines = raw.split(b"\n")
    counts = Counter(words)
    dropped = lambda chars: n - len(raw.translate(None, chars))
    per = 1.0 / max(n, 1)
    per_word = 1.0 / max(w, 1)
    symbols = len(raw.translate(None, _PLAIN))
    pairs = len(set(zip(words, words[1:], strict=False))) if w > 1 else 1
    packed = sum(len(zlib.compress(raw[i : i + (1 << 16)], 1)) for i in range(0, n, 1 << 16)) if n else 0
    return [
        np.log1p(n), np.log1p(w), float(lengths.mean()) if w else 0.0, float(lengths.std()) if w else 0.0,
        float((lengths > 14).mean()) if w else 0.0, float((lengths < 3).mean()) if w else 0.0, len(counts) * per_word,
        max(counts.values(), default=0) * per_word, symbols * per, dropped(_DIGITS) * per, dropped(_UPPER) * per,
        dropped(bytes(range(128, 256))) * per, raw.count(b".") * per_word, raw.count(b",") * per_word, len(lines) * per_word,
        len(set(lines)) / len(lines), n / len(lines), raw.count(b"|") * per_word, symbols * per_word,
        sum(c for k, c in counts.items() if k.lower() in COMMON) * per_word, raw.count(b"  ") * per_word, dropped(_ODD) * per,
        1 - pairs / max(w - 1, 1), packed * per,
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([statistics(t) for t in texts(batch)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


# --- the model --------------------------------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees as flat arrays: node i of tree t is at ``root[t] + i``; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features; missing values go right."""
        total = np.full(len(x), self.base)
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            rows = np.arange(len(part))[:, None]
            at = np.broadcast_to(self.root, (len(part), len(self.root)))
            for _ in range(self.depth):
                goes = part[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(goes, self.left[at], self.right[at])
            total[lo : lo + 2048] += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_split(hist: np.ndarray, ridge: float, least: int) -> tuple[float, int, int]:
    """(gain, feature, bin) over histograms (features, bins, [gradient, hessian, rows])."""
    left = hist.cumsum(axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    part = lambda h: h[..., 0] ** 2 / (h[..., 1] + ridge)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), part(left) + part(right) - part(whole), -1.0)
    best = int(gain.argmax())
    return float(gain.flat[best]), best // hist.shape[1], best % hist.shape[1]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, leaves: int = LEAVES, rate: float = RATE, bins: int = BINS, least: int = LEAST_ROWS, ridge: float = RIDGE) -> Forest:
    """Boosted trees for the logistic loss. With one class, or no rows, a forest that always gives that share."""
    n, width = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]) if n else np.zeros((0, width), np.int64)
    slots = binned + np.arange(width) * bins
    score = np.full(n, base)
    nodes: list[list[float]] = []
    roots, depth = [], 1

    def histogram(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        flat = slots[rows].ravel()
        weights = (np.repeat(v[rows], width) for v in (g, h))
        sums = [np.bincount(flat, w, width * bins) for w in weights] + [np.bincount(flat, minlength=width * bins)]
        return np.stack(sums, axis=-1).reshape(width, bins, 3)

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        start = len(nodes)
        roots.append(start)
        nodes.append([0, np.inf, start, start, 0.0])
        rows = np.arange(n)
        hist = histogram(rows, g, h)
        open_ = [(_best_split(hist, ridge, least), start, rows, hist, 1)]
        final = []
        while open_ and len(open_) + len(final) < leaves:
            open_.sort(key=lambda o: o[0][0])
            (gain, j, b), node, rows, hist, level = open_.pop()
            if gain <= 1e-9:
                final.append((node, rows, hist))
                continue
            goes = binned[rows, j] <= b
            one, two = rows[goes], rows[~goes]
            smaller = one if len(one) <= len(two) else two
            own = histogram(smaller, g, h)
            hists = (own, hist - own) if smaller is one else (hist - own, own)
            at = len(nodes)
            nodes[node] = [j, edges[j][b] if b < len(edges[j]) else np.inf, at, at + 1, 0.0]
            nodes.extend([[0, np.inf, at + k, at + k, 0.0] for k in (0, 1)])
            depth = max(depth, level)
            for k, (part, its) in enumerate(zip((one, two), hists, strict=True)):
                open_.append((_best_split(its, ridge, least), at + k, part, its, level + 1))
        for node, rows, hist in final + [(o[1], o[2], o[3]) for o in open_]:
            s = hist[0].sum(axis=0)
            nodes[node][4] = rate * s[0] / (s[1] + ridge)
            score[rows] += nodes[node][4]
    table = np.array(nodes, np.float64).reshape(-1, 5)
    ints = table[:, [0, 2, 3]].astype(np.int32)
    return Forest(ints[:, 0], table[:, 1], ints[:, 1], ints[:, 2], table[:, 4], np.array(roots, np.int32), depth, base)


# --- DataFrame operators ----------------------------------------------------------------------------------------


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string")) % of


def training_ids(labels: DataFrame, keep: Column, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, y) of the labelled documents to learn from."""
    own = labels.where(F.col(label).isNotNull() & keep).groupBy("doc_id").agg(F.max(label).alias("y"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(known: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Forest:
    """Fit on (doc_id, x) joined with labels, of the rows for which ``keep`` holds.

    At most ``max_rows`` rows are used, those whose doc_id hashes lowest, so that the same rows are taken each time. A
    doc_id with several labels counts once, with the greatest; several texts of one doc_id count each.
    """
    picked = training_ids(labels, keep, label, max_rows)
    rows = known.join(picked, "doc_id").select("doc_id", "x", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    flat = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(y) else np.zeros(0)
    return fit(flat.reshape(len(y), len(FEATURES)), (y > 0).astype(np.float64))


def score_features(known: DataFrame, model: Forest) -> DataFrame:
    """(doc_id, score) from (doc_id, x)."""
    held = known.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
        return pa.record_batch([batch.column(0), pa.array(held.value.score(x))], names=["doc_id", "score"])

    return arrow_map(known, run, "doc_id long, score double")


def score_documents(docs: DataFrame, model: Forest, column: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text; a column of that name is replaced."""
    docs = docs.drop(column)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in texts(batch)], np.float64).reshape(-1, len(FEATURES))
        return batch.append_column(column, pa.array(held.value.score(x)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{fields}, `{column}` double")


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> Forest:
    """A model from the labelled rows of ``docs``; only the texts of the bounded sample are looked at."""
    keep = fold(F.col("doc_id"), folds) != held_out
    # At most MAX_TRAINING_ROWS ids, so they may be broadcast.
    picked = F.broadcast(training_ids(labels, keep).select("doc_id"))
    return train(features(docs.select("doc_id", "text").join(picked, "doc_id", "left_semi")), labels, keep)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; labels of the held-out fold are never learned from.

    Defined cases: null texts count as empty and get the score of an empty text; without labels, or with labels of one
    value, every score is the smoothed share of label 1; null doc_ids are scored and never held out; repeated rows stay
    repeated; other columns are ignored.
    """
    known = cut(features(docs), "statistics")
    model = train(known, labels, fold(F.col("doc_id"), folds) != held_out, max_rows=max_rows)
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return score_features(known, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
