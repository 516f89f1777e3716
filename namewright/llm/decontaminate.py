"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of all items (words as integers) is built once per shard of bounded size and broadcast. Training words are
streamed through it, and the longest match that ends at each word is tracked: where it is at least a window long, the
window's words are hit. Stretches of words that hold no run of item word pairs as long as the shortest window cannot hold
a window and are skipped by one vectorised look-up, so that only the rest goes through the automaton.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import read
from namewright.session import cut

WINDOW = 10
#: Item characters of one automaton. More items than that are dealt over several automata, each with a pass of its own.
SHARD_CHARS = 4_000_000

#: Lower-cases A-Z and turns each of `[\x00-\x2F\x3A-\x60\x7B-\x7F]` (after lower-casing) into a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class ItemAutomaton:
    """Generalised suffix automaton over item words, with the items of each window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]) for i, ws in items if ws]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: For the state of each window: the items that hold it, and its length.
        self.items: dict[int, set[int]] = defaultdict(set)
        self.short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, ids in coded:
            if len(ids) < window:
                state, _ = self._step(ids, 0, 0)[-1]
                self.short[state].append((len(ids), item))
            else:
                for state, length in self._step(ids, 0, 0):
                    if length >= window:
                        self.items[self._up(state, window)].add(item)
        lengths = [min(len(ids), window) for _, ids in coded]
        #: One-word items hit by themselves; the pairs of words of the longer ones tell where matches can be.
        self.single = {ids[0] for _, ids in coded if len(ids) == 1}
        self.least = min((n for n in lengths if n > 1), default=0)
        self.base = len(self.vocabulary) + 1
        pairs = {a * self.base + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        self.mask = np.zeros(1 << max(16, (16 * len(pairs)).bit_length()), bool)
        self.mask[self._slot(np.array(sorted(pairs), np.int64))] = True

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * np.int64(0x9E3779B1)) >> 7 & (len(self.mask) - 1)

    def _copy(self, p: int, q: int, c: int) -> int:
        """Split off from q the state of the strings of at most length(p) + 1."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, c)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, c)
        return new

    def _step(self, ids: list[int], state: int, length: int) -> list[tuple[int, int]]:
        """The state and the longest matching length after each word."""
        out, nexts, link, lengths = [], self.next, self.link, self.length
        for c in ids:
            while state and c not in nexts[state]:
                state = link[state]
                length = lengths[state]
            to = nexts[state].get(c)
            state, length = (0, 0) if to is None else (to, length + 1)
            out.append((state, length))
        return out

    def _up(self, state: int, length: int) -> int:
        """The suffix state that holds the string of this length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def match(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of hit words, merged, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if self.single and np.isin(ids, list(self.single)).any():
            stretches = self._stretches(np.concatenate([[0], ids, [0]]) > 0, 1)
        elif self.least and len(ids) >= self.least:
            pair = self.mask[self._slot(ids[:-1].astype(np.int64) * self.base + ids[1:])] & (ids[:-1] > 0) & (ids[1:] > 0)
            stretches = [(a, b + 1) for a, b in self._stretches(np.concatenate([[False], pair, [False]]), self.least - 1)]
        else:
            stretches = []
        for lo, hi in stretches:
            for at, (state, length) in enumerate(self._step(ids[lo:hi].tolist(), 0, 0), lo + 1):
                size = 0
                if length >= self.window:
                    size = self.window
                    found |= self.items[self._up(state, size)]
                if self.short:
                    up = state
                    while up > 0:
                        for n, item in self.short.get(up, ()):
                            if n <= length:
                                found.add(item)
                                size = max(size, n)
                        up = self.link[up]
                if size:
                    spans.append((at - size, at))
        return _merged(spans), found

    @staticmethod
    def _stretches(padded: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Runs of True of at least this length in an array with one False at either end."""
        edges = np.flatnonzero(padded[1:] != padded[:-1]).reshape(-1, 2)
        return [(int(a), int(b)) for a, b in edges if b - a >= least]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Words of the text, spans of hit words and the items found."""
        own = words(text)
        ids = np.array(list(map(self.vocabulary.get, own, repeat(0))), np.int32)
        return len(own), *self.match(ids)


class Shards:
    """The benchmark's items, dealt over automata of bounded size; each is built when it is asked for."""

    def __init__(self, benchmark: DataFrame, window: int, shard_chars: int):
        items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL")
        self.window = window
        self.n = (items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // shard_chars + 1
        items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)))
        self.items = items if self.n == 1 else cut(items, "benchmark-items")

    def automaton(self, k: int):
        """Shard k, broadcast. The driver holds one shard's items, whose size is checked, at a time."""
        own = self.items.where(F.col("shard") == k).select("item_id", "text")
        held = ItemAutomaton([(r["item_id"], words(r["text"])) for r in own.toLocalIterator()], self.window)
        return self.items.sparkSession.sparkContext.broadcast(held)


_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.int64()))])
_HITS_SQL = "struct<n_words:long,spans:array<struct<a:int,b:int>>,items:array<long>>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """All columns of ``docs`` and hits: struct of n_words, spans (of words, end exclusive) and items.

    A document word inside any occurrence of a window is hit; a window is ``window`` consecutive words of an item, or
    the whole of a shorter item. Defined cases: null texts have no words; items without words or with a null item_id
    have no window; rows that share an item_id are one item; repeated documents stay repeated; an empty benchmark hits
    nothing; a column ``hits`` of ``docs`` is replaced, others of any name are passed on.
    """
    docs = docs.drop("hits")
    return _scanned(_plain(docs), Shards(benchmark, window, shard_chars)).toDF(*docs.columns, "hits")


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with names of its own for all columns but text, which those of the scan cannot clash with."""
    return docs.toDF(*("text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)))


def _scanned(docs: DataFrame, shards: Shards) -> DataFrame:
    """``docs`` and a last column hits. Several shards are as many passes, written in between, so that a task holds one."""
    out = docs
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for k in range(shards.n):
        held = shards.automaton(k)

        def run(batches, held=held):
            for batch in batches:
                known = batch.schema.get_field_index("hits")
                found = [held.value.scan(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
                if known >= 0:
                    before = batch.column(known).to_pylist()
                    found = [(n, _merged([*((x["a"], x["b"]) for x in was["spans"]), *spans]), items.union(was["items"])) for was, (n, spans, items) in zip(before, found, strict=True)]
                hits = [{"n_words": n, "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(items)} for n, spans, items in found]
                columns = batch.columns[:known] if known >= 0 else batch.columns
                yield pa.record_batch([*columns, pa.array(hits, _HITS)], names=[*batch.schema.names[: len(columns)], "hits"])

        out = out.mapInArrow(run, f"{fields}, hits {_HITS_SQL}")
        if shards.n > 1:
            out = cut(out, "hits")
            held.unpersist()
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, with those that meet joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, items (sorted ids) and contaminated."""
    hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    found = scan(docs.select("doc_id", "text"), benchmark, window)
    return found.select("doc_id", F.col("hits.n_words").alias("n_words"), hit.alias("n_hit"), F.col("hits.items").alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def _gone(n: int, spans: list[tuple[int, int]], max_words: int, max_coverage: float, window: int) -> list[tuple[int, int]]:
    """The spans beyond the limits, of a text of n words. One below the window can only be of whole shorter items, and goes."""
    covered = sum(b - a for a, b in spans)
    return [(a, b) for a, b in spans if b - a > max_words or b - a < window or covered > max_coverage * n]


def cleaned(automaton: ItemAutomaton, text: str | None, max_words: int, max_coverage: float) -> str | None:
    """The text without spans beyond the limits; what a cut brings together is scanned again."""
    while text:
        n, spans, _ = automaton.scan(text)
        gone = _gone(n, spans, max_words, max_coverage, automaton.window)
        if not gone:
            break
        text = _without(text, gone)
    return text


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_words: int = WINDOW - 1, max_coverage: float = 0.5, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` without the passages that benchmark items share: hit spans of more than ``max_words`` words go.

    So do whole items shorter than a window, each of which is one window, wherever they stand. Where more than ``max_coverage``
    of the words are hit, every hit span goes whatever its length. The result does not depend on the number of automata: each
    round of cuts is decided on the spans of all, and changed texts go through all again. Defined cases: documents keep their row,
    repeats too; one of which nothing is left gets an empty text, a null text stays null; an empty table gives no rows; other
    columns of any name are passed on; n_chars, if there, is counted anew.
    """
    shards = Shards(benchmark, window, shard_chars)
    out = _cleaned_at_once(docs, shards, max_words, max_coverage) if shards.n == 1 else _cleaned_in_rounds(docs, shards, max_words, max_coverage)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def _cleaned_at_once(docs: DataFrame, shards: Shards, max_words: int, max_coverage: float) -> DataFrame:
    held = shards.automaton(0)

    def clean(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = pa.array([cleaned(held.value, t.as_py(), max_words, max_coverage) for t in batch.column(at)], pa.string())
            yield pa.record_batch([new if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(clean, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def _cleaned_in_rounds(docs: DataFrame, shards: Shards, max_words: int, max_coverage: float) -> DataFrame:
    """``cleaned`` by several automata: a round for all texts, and further ones for those that the last one changed."""

    def clean(batches):
        for batch in batches:
            at, hits = (batch.schema.get_field_index(c) for c in ("text", "hits"))
            new = []
            for text, hit in zip(batch.column(at), batch.column(hits), strict=True):
                text, hit = text.as_py(), hit.as_py()
                gone = _gone(hit["n_words"], [(s["a"], s["b"]) for s in hit["spans"]], max_words, max_coverage, shards_window)
                new.append((_without(text, gone) if gone else text, bool(gone)))
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "hits"}
            columns["text"] = pa.array([t for t, _ in new], pa.string())
            yield pa.record_batch([*columns.values(), pa.array([c for _, c in new], pa.bool_())], names=[*columns, "changed"])

    shards_window, todo = shards.window, _plain(docs)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema.fields)
    done = None
    while True:
        after = cut(_scanned(todo, shards).mapInArrow(clean, f"{fields}, changed boolean"), "decontaminated")
        settled, todo = (after.where(c).drop("changed") for c in (~F.col("changed"), F.col("changed")))
        done = settled if done is None else done.union(settled)
        if todo.isEmpty():
            return done.toDF(*docs.columns)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    kept.append(raw[last:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")

