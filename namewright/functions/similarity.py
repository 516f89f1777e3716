"""Insert/delete similarity from the longest common subsequence (LCS).

Two forms of the bit-parallel LCS recurrence: a numpy kernel that scores one query against a whole matrix of keys at once, for
keys of any length, and a column expression for keys of up to 62 characters that stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SQL_CHARS = 62
_ALL = np.uint64(2**64 - 1)


class KeyMatrix:
    """Keys as columns of letters, longest keys first, so that a step over one position touches just the keys that reach it."""

    def __init__(self, keys: list[str]):
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.order = np.argsort(-self.lengths, kind="stable")
        codes, letters = np.unique(np.concatenate([np.frombuffer(keys[i].encode("utf-32-le"), "<u4") for i in self.order] or [np.zeros(0, np.uint32)]), return_inverse=True)
        self.alphabet = {int(c): i for i, c in enumerate(codes)}
        sorted_lengths = self.lengths[self.order]
        starts = np.cumsum(sorted_lengths) - sorted_lengths
        width = int(self.lengths.max(initial=0))
        reach = np.searchsorted(-sorted_lengths, -np.arange(width), side="left")
        self.columns = [letters[starts[:n] + at].astype(np.intp) for at, n in enumerate(reach)]

    def lcs(self, query: str) -> np.ndarray:
        """The LCS length of the query and each key."""
        words = max(1, -(-len(query) // 64))
        masks = np.zeros((words, max(len(self.alphabet), 1)), np.uint64)
        for at, c in enumerate(query):
            slot = self.alphabet.get(ord(c))
            if slot is not None:
                masks[at // 64, slot] |= np.uint64(1 << (at % 64))
        states = [np.full(len(self.lengths), _ALL) for _ in range(words)]
        u, total = (np.empty(len(self.lengths), np.uint64) for _ in range(2))
        for column in self.columns:
            n = len(column)
            met, added, carry = u[:n], total[:n], None
            for w in range(words):
                s = states[w][:n]
                np.take(masks[w], column, out=met)
                met &= s
                np.add(s, met, out=added)
                if words > 1:
                    over = added < s
                    if carry is not None:
                        added += carry
                        over |= added < carry
                    carry = over.astype(np.uint64)
                s -= met
                s |= added
        out = np.zeros(len(self.lengths), np.int64)
        for w, s in enumerate(states):
            used = min(64, len(query) - 64 * w)
            if used > 0:
                out[self.order] += np.bitwise_count(~s & np.uint64((1 << used) - 1))
        return out

    def ratio(self, query: str) -> np.ndarray:
        """100 * 2 LCS / (both lengths); 100 where both are empty. One division, so equal fractions are equal numbers."""
        total = self.lengths + len(query)
        return np.where(total > 0, 2.0 * self.lcs(query) / np.maximum(total, 1), 1.0) * 100.0


def lcs_length(one: str, other: str) -> int:
    return int(KeyMatrix([other]).lcs(one)[0])


def indel_distance(one: str, other: str) -> int:
    return len(one) + len(other) - 2 * lcs_length(one, other)


def ratio(one: str, other: str) -> float:
    return float(KeyMatrix([other]).ratio(one)[0])


# --- column expressions ---------------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda a repeated expression would be evaluated at each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lcs_column(one: Column, other: Column) -> Column:
    """The LCS length. Masking each step keeps the sum below overflow for ``one`` of at most MAX_SQL_CHARS characters; a longer
    one goes through the table of lengths, a row for each letter of ``other``."""
    letters = F.filter(F.split(other, ""), lambda c: c != "")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    full = bit(F.length(one)) - 1
    places = F.sequence(F.lit(0), F.greatest(F.length(one) - 1, F.lit(0)))
    bits = lambda c: F.aggregate(places, F.lit(0).cast("long"), lambda m, i: F.when(F.substring(one, i + 1, F.lit(1)) == c, m.bitwiseOR(bit(i))).otherwise(m))

    def step(s: Column, c: Column) -> Column:
        return let(s.bitwiseAND(bits(c)), lambda u: (s + u).bitwiseOR(s - u).bitwiseAND(full))

    short = F.aggregate(letters, full, step, lambda s: F.bit_count(F.bitwise_not(s).bitwiseAND(full)))
    none = F.transform(F.sequence(F.lit(0), F.length(one)), lambda _: F.lit(0))

    def row(above: Column, c: Column) -> Column:
        def add(done: Column, i: Column) -> Column:
            same = F.substring(one, i, F.lit(1)) == c
            best = F.when(same, F.get(above, i - 1) + 1).otherwise(F.greatest(F.get(above, i), F.get(done, i - 1)))
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(one)), F.array(F.lit(0)), add)

    long = F.aggregate(letters, none, row, lambda r: F.get(r, F.length(one)))
    return F.when(F.length(one) > MAX_SQL_CHARS, long).otherwise(short)


def indel_column(lcs: Column, one: Column, other: Column) -> Column:
    return F.length(one) + F.length(other) - 2 * lcs


def ratio_column(lcs: Column, one: Column, other: Column) -> Column:
    total = F.length(one) + F.length(other)
    return F.when(total > 0, 2.0 * lcs / total).otherwise(1.0) * 100.0


def published_score(score: Column) -> Column:
    """A score as it is reported: through single precision, four decimals, halves up."""
    return F.floor(score.cast("float").cast("double") * 1e4 + 0.5) / 1e4
