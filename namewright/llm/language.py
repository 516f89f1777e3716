"""Language ID of whole texts, with spans of mixed-language text.

Words are runs of letters. The script of a word (by code point ranges) leaves only the languages that training texts write
in it; these are scored by their character n-grams, and Viterbi over the words, with a penalty for each switch, labels spans.
A document's language is the one that labels the most letters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import read

#: Runs of letters, but for signs that the class of words has too, such as ² or ½.
_RUN = re.compile(r"[^\W\d_]+")
#: Characters of the texts that are labelled at once.
LABEL_CHARS = 1 << 21
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
#: About so many whole texts of each language (those of least hash) are learned from; predictions have no such bound.
MAX_TRAINING_ROWS = 6_000
SWITCH = 6.0
SMOOTHING = 0.5
#: A script is one of a language's if more than this share of its training letters is written in it.
SCRIPT_SHARE = 0.001
KNOWN_WORDS = 400_000

#: First code points of ranges of letters and their scripts (Unicode blocks).
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1380, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"),
    (0x3200, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
_STARTS = [a for a, _ in SCRIPT_RANGES]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_NUMBER = {s: i for i, s in enumerate(SCRIPTS)}
_LATIN = _NUMBER["Latin"]


def letter_words(text: str) -> list[str]:
    """The runs of letters (Unicode categories L*)."""
    found = _RUN.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for w in found for letters, run in groupby(w, str.isalpha) if letters]


def script_of(word: str) -> int:
    """The number of the script of the word's first letter."""
    first = ord(word[0])
    return _LATIN if first < 0x370 else _NUMBER[SCRIPT_RANGES[bisect_right(_STARTS, first) - 1][1]]


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, owner): the hash slot of each n-gram of each word (its ends marked), and the place of its word."""
    joined = "\0" + "\0".join(words) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.cumsum(code == 0) - 1
    slots, owners = [], []
    run = np.zeros(len(code), np.int64)
    inner = np.ones(len(code), bool)
    for n in range(1, max(GRAMS) + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        run = (run[:size] * 1_000_003 + code[n - 1 :] + n) & 0x3FFFFFFFFFF
        # A mark may only be the first or the last character; the run's first word owns it.
        inner = inner[:size] & (code[n - 2 : n - 2 + size] != 0) if n > 2 else np.ones(size, bool)
        good = inner if n > 1 else code != 0
        slots.append(((run[good] * 0x9E3779B1 >> 13) & (BUCKETS - 1)))
        owners.append(owner[:size][good])
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    real = owners < len(words)
    return slots[real], owners[real]


@dataclass
class LanguageModel:
    langs: list[str]
    grams: np.ndarray  # (BUCKETS, langs): log P(gram | lang), less the mean over languages
    scripts: np.ndarray  # (scripts, langs): whether the language is written so
    switch: float = SWITCH
    known: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)
    used: int = 0

    def __getstate__(self):
        return {"langs": self.langs, "grams": self.grams, "scripts": self.scripts, "switch": self.switch, "known": {}, "scores": None, "used": 0}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, langs): log scores, very low where the script rules a language out."""
        slots, owners = gram_slots(words)
        out = np.zeros((len(words), len(self.langs)))
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(owners, self.grams[slots, j], len(words))
        allowed = self.scripts[np.fromiter(map(script_of, words), np.int64, len(words))]
        # A script that no language is written in tells nothing.
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), out, -1e4)

    def _lookup(self, words: list[str]) -> np.ndarray:
        """Scores of words, remembered by word."""
        got = list(map(self.known.get, words))
        if None in got:
            if self.scores is None or len(self.known) > KNOWN_WORDS:
                self.known.clear()
                self.scores, self.used = np.zeros((1024, len(self.langs))), 0
                got = [None] * len(words)
            new = list(dict.fromkeys(w for w, g in zip(words, got, strict=True) if g is None))
            while self.used + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[self.used : self.used + len(new)] = self.word_scores(new)
            self.known.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
            got = list(map(self.known.get, words))
        return self.scores[np.array(got, np.int64)]

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its words' lengths and languages (numbers), by Viterbi over all texts of a batch at once."""
        found = [letter_words(t.lower()) for t in texts]
        sizes = np.array([len(f) for f in found])
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        if not longest:
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in texts]
        scores = self._lookup([w for f in found for w in f])
        starts = np.cumsum(sizes) - sizes
        start = starts[order]
        width = np.array([(sizes > t).sum() for t in range(longest)]) if longest < 64 else np.searchsorted(np.sort(-sizes), -np.arange(longest), side="left")
        best = np.zeros((len(texts), len(self.langs)))
        # Whether the best way to this word's language comes from another language, and from which.
        jumps = np.zeros(scores.shape, bool)
        source = np.zeros(len(scores), np.int8 if len(self.langs) < 128 else np.int32)
        for t in range(longest):
            n = width[t]
            at = start[:n] + t
            now = best[:n]
            if t:
                top = now.argmax(axis=1)
                jump = now[np.arange(n), top][:, None] - self.switch
                moved = jump > now
                jumps[at], source[at] = moved, top
                now = np.where(moved, jump, now)
            best[:n] = now + scores[at]
        labels = np.zeros(len(scores), np.int64)
        here = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = width[t]
            at = start[:n] + t
            labels[at] = here[:n]
            here[:n] = np.where(jumps[at, here[:n]], source[at], here[:n])
        lengths = np.fromiter((len(w) for f in found for w in f), np.int64, len(scores))
        return [(lengths[a : a + n], labels[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]

    def predict(self, texts: list[str]) -> list[tuple[str, float, list[tuple[str, int]]]]:
        """(language, share of letters it labels, spans as (language, words)) of each text; `und` without letters."""
        if not self.langs:
            return [("und", 0.0, []) for _ in texts]
        out = []
        for lengths, labels in self.label(texts):
            if not len(labels):
                out.append(("und", 0.0, []))
                continue
            letters = np.bincount(labels, lengths, len(self.langs))
            top = int(letters.argmax())
            edges = np.flatnonzero(np.diff(labels)) + 1
            bounds = [0, *edges.tolist(), len(labels)]
            spans = [(self.langs[labels[a]], b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
            out.append((self.langs[top], float(letters[top] / letters.sum()), spans))
        return out


def train(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> LanguageModel:
    """A model of the languages of ``docs`` (doc_id, text, lang).

    Each language learns from about ``max_rows`` whole documents, those of least hash: this bounds the sample. The counts
    are distributed, and what reaches the driver is a table of slots.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    # Rows per language decide the hash threshold below which about max_rows of them are; no row is sorted. There is a row
    # for each language of the table, of which a corpus has some hundreds.
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.coalesce(F.get(F.array(*(F.lit(float((1 << 20) * max_rows / counts[x])) for x in langs)), F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1), F.lit(0.0))
    place = {x: i for i, x in enumerate(langs)}

    def count(batches):
        grams, scripts = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), len(SCRIPTS)), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := letter_words(text.lower()):
                    grams[place[lang]] += np.bincount(gram_slots(words)[0], minlength=BUCKETS)
                    scripts[place[lang]] += np.bincount(np.fromiter(map(script_of, words), np.int64, len(words)), np.fromiter(map(len, words), np.int64, len(words)), len(SCRIPTS)).astype(np.int64)
        for i in range(len(langs)):
            for kind, row in ((0, grams[i]), (1, scripts[i])):
                slots = np.flatnonzero(row)
                if len(slots):
                    yield pa.record_batch([pa.array(np.full(len(slots), i, np.int32)), pa.array(np.full(len(slots), kind, np.int32)), pa.array(slots.astype(np.int32)), pa.array(row[slots])], names=["lang", "kind", "slot", "n"])

    counted = known.where(picked).select("lang", "text").mapInArrow(count, "lang int, kind int, slot int, n long")
    rows = counted.groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    lang, kind, slot, n = (rows.column(c).to_numpy() for c in ("lang", "kind", "slot", "n"))
    grams, scripts = np.full((BUCKETS, len(langs)), SMOOTHING), np.zeros((len(SCRIPTS), len(langs)))
    grams[slot[kind == 0], lang[kind == 0]] += n[kind == 0]
    scripts[slot[kind == 1], lang[kind == 1]] = n[kind == 1]
    logs = np.log(grams / grams.sum(axis=0))
    return LanguageModel(langs, logs - logs.mean(axis=1, keepdims=True), scripts > SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def detect(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each whole text; a span is a language and its number of words.

    Defined cases: `und` with score 0 and no spans if the text is null or has no letter; ties go to the language first in
    code point order; repeated rows stay repeated; an empty table gives no rows; other columns are ignored. Texts are labelled
    together up to LABEL_CHARS characters; a longer one is labelled alone and takes memory in proportion to its length.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            chars = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                before = int(chars[lo - 1]) if lo else 0
                n = min(max(1, int(np.searchsorted(chars, before + LABEL_CHARS, side="right")) - lo), 1024)
                part = batch.slice(lo, n)
                lo += n
                found = held.value.predict([t or "" for t in part.column(1).to_pylist()])
                spans = pa.array([[{"lang": x, "words": n} for x, n in f[2]] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())])))
                yield pa.record_batch([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,words:long>>")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs.where(~held))
    return detect(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
