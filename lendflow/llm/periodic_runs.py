"""Periodic runs of words by a dictionary of basic factors.

The dictionary names, for every power of two m, the factors of m words of a document: equal factors of one
document have equal names, and a factor that occurs once has none.  The names of 2m words follow from pairs
of names of m words, and no level is built beyond the first without a repeated factor.

Proposals.  A run of smallest period q and at least three periods holds, for m = the largest power of two
up to q, a factor whose next occurrence is exactly q words on: a primitive cycle of q words has at least
m + 1 different factors of m < q words, so at least three of its q places hold one that occurs nowhere else
in the cycle (q < 2m).  Hence the occurrences that follow one another at a distance of m up to 2m, arithmetic
progressions in a run, propose every period.  Neighbouring places that propose the same one lie in one
stretch; the first of them stands for it.

Each proposal is extended to both sides by the dictionary itself (longest common extension of the places
i and i + q, one step a level), and the members of a progression give the same stretch.  A stretch is maximal
for its smallest period whenever it is maximal for a multiple of it, so of equal stretches the smallest
period stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendflow.llm.common import WORD, mix64, text_slices, word_hashes, word_spans

LEAST, PERIODS = 24, 3               # a run's least length in words and in periods

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Factors:
    """Names of the factors of 1, 2, 4, ... words at every place; -1 where a factor occurs once in its
    document or would pass its end.  ``first`` holds each document's first word (+ the total)."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n = len(words)
        self.end = np.repeat(first[1:], np.diff(first))
        document = np.repeat(np.arange(1, len(first), dtype=np.uint64), np.diff(first))
        keys, places = mix64(words ^ mix64(document)), np.arange(n)
        self.levels: list[np.ndarray] = []
        self.steps: list[np.ndarray] = []        # distance to the factor's next occurrence, 0 without one
        size = 1
        while True:
            names, step = self._level(keys, places, n)
            if not (names >= 0).any():
                break
            self.levels.append(names)
            self.steps.append(step)
            places = np.flatnonzero(names[:n] >= 0)
            places = places[places + 2 * size <= self.end[places]]
            places = places[names[places + size] >= 0]
            keys = names[places].astype(np.int64) * (n + 1) + names[places + size]
            size *= 2

    @staticmethod
    def _level(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        names, step = np.full(n + 1, -1, np.int32), np.zeros(n, np.int32)
        if len(places):
            order = np.argsort(keys, kind="stable")
            at, same = places[order], np.diff(keys[order]) == 0
            repeated = np.r_[same, False] | np.r_[False, same]
            group = np.cumsum(np.r_[False, ~same])
            names[at[repeated]] = group[repeated]
            step[at[:-1][same]] = np.diff(at)[same]
        return names, step

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in which the texts from places ``a`` and ``b`` on agree."""
        a, b, start = a.copy(), b.copy(), a
        for level in reversed(range(len(self.levels))):
            names, last = self.levels[level], len(self.end)
            x, y = names[np.minimum(a, last)], names[np.minimum(b, last)]
            same = (x == y) & (x >= 0)
            a[same] += 1 << level
            b[same] += 1 << level
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in which the texts before places ``a`` and ``b`` agree (``a`` < ``b``)."""
        a, b, start = a.copy(), b.copy(), a
        for level in reversed(range(len(self.levels))):
            names, size = self.levels[level], 1 << level
            x, y = names[np.where(a >= size, a - size, -1)], names[np.where(b >= size, b - size, -1)]
            same = (x == y) & (x >= 0)
            a[same] -= size
            b[same] -= size
        return start - a

    def runs(self, least: int, periods: int) -> np.ndarray:
        """(runs, 3): start, length and smallest period, by start, then period.  ``periods`` is 3 or more."""
        found = []
        for level, step in enumerate(self.steps):
            size = 1 << level
            at = np.flatnonzero((step >= size) & (step < 2 * size))
            if not len(at):
                continue
            q = step[at].astype(np.int64)
            left = np.maximum(at - 1, 0)
            again = (at > 0) & (step[left] == q) & (self.end[left] == self.end[at])
            at, q = at[~again], q[~again]
            before = self.backward(at, at + q)
            length = before + q + self.forward(at, at + q)
            long_enough = length >= np.maximum(least, periods * q)
            found.append(np.stack([at - before, length, q], axis=1)[long_enough])
        if not found:
            return np.zeros((0, 3), np.int64)
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (np.diff(rows[:, :2], axis=0) != 0).any(1)
        rows = rows[new]
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def surplus(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def find_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST,
              periods: int = PERIODS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, its runs (start, length, period in words, by start, then
    period) and the collapsed text: the words that no run holds behind its first period, joined by one space.

    A run is a stretch of words whose smallest period is q, at least ``least`` words and ``periods`` (three
    or more) times q long, that neither neighbour extends.  Words are runs of bytes other than ASCII white
    space, told apart by 64-bit digests.  A null, empty or blank text has no words, no runs and an empty
    collapsed text; repeated rows and null ids are answered row by row; other columns are not read.  Documents
    are independent, so this is one pass without a shuffle.  A task holds a slice of about 1 MB (or
    one longer text) with four bytes a word and level, and only as many levels as repeated factors need."""
    if periods < 3:
        raise ValueError("periods must be 3 or more")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id")
            for lo, hi, raw, offsets in text_slices(batch, "body"):
                starts, ends, first = word_spans(raw, offsets)
                n = len(starts)
                runs = Factors(word_hashes(raw, starts, ends), first).runs(least, periods)
                gone = surplus(runs, n)
                row = np.searchsorted(first, runs[:, 0], side="right") - 1
                place = runs[:, 0] - first[row]
                cuts = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                texts = []
                for i in range(hi - lo):
                    words = raw[offsets[i]:offsets[i + 1]].tobytes().split()
                    drop = gone[first[i]:first[i + 1]]
                    if drop.any():
                        words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                    texts.append(b" ".join(words))
                entries = pa.StructArray.from_arrays(
                    [pa.array(c, pa.int64()) for c in (place, runs[:, 1], runs[:, 2])], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(cuts), entries),
                     pa.array(texts, pa.binary()).view(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("body"))
    return rows.mapInArrow(search, RUNS)


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length / period, compared exactly (ties: smallest start, then period); null
    without a run."""
    return F.reduce(runs, F.get(F.col(runs), F.lit(0)), lambda best, run: F.when(
        run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best))


def with_cycles(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` (doc_id, text) in which every tenth document, by the crc32 h of its decimal id, repeats a stretch
    of its words to its end: with g = h / 10, n words, a = g % n and p = 1 + (n - a) / (3 + g % 8), each word
    i >= a becomes word a + (i - a) % p.  Other documents, and those without an id or a word, stay as they are."""
    h = F.crc32(F.col(f"`{doc_id}`").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))
    chosen = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
        F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w").cast("long")
    with_n = chosen.withColumn("n", F.when(n > 0, n)).withColumn("a", F.expr("g % n"))
    with_p = with_n.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    cycled = F.expr("array_join(transform(sequence(0L, n - 1), "
                    "i -> get(w, CAST(if(i < a, i, a + (i - a) % p) AS INT))), ' ')")
    return with_p.select("doc_id", F.when(F.col("n").isNotNull(), cycled).otherwise(F.col("text")).alias("text"))
