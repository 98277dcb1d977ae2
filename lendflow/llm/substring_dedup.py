"""Repeated word windows by compressed full-text indexes.

Documents are narrowed to the contexts that can hold a partial repeat (see ``anchors``).  A shard indexes
its contexts as one text over its own vocabulary: the Burrows-Wheeler transform in a wavelet tree of bit
vectors with counted blocks, and no text beside it.  The contexts are then streamed through the index.
Backward search extends each window one word to the left at a time, all windows at once; its matching
statistic is settled when it has reached the span, or earlier when only its own occurrence is left.  A
window that reaches the span with an occurrence in a document with a smaller id is a repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendflow.llm.anchors import Scheme, digest, marked_documents, removed, sums
from lendflow.llm.common import word_hashes, word_spans

SPAN = 50                            # words of a repeat
WIDTH = 12                           # words of an anchor's gram
SHARD_BYTES = 2 << 20
QUERIES = 1 << 17                    # windows searched at once


class BitVector:
    """Bits in 64-bit blocks with the number of ones before each block."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        raw = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros(self.n // 64 + 1, dtype=np.uint64)
        self.blocks.view(np.uint8)[:len(raw)] = raw
        self.before = np.zeros(len(self.blocks) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.blocks), out=self.before[1:])
        self.zeros = self.n - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.blocks[block] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)


class WaveletTree:
    """Occurrence counts of symbols in prefixes of a sequence: one bit vector per symbol bit, each level
    ordered by the bits above it."""

    def __init__(self, codes: np.ndarray):
        self.levels: list[BitVector] = []
        self.bits = max(1, int(codes.max(initial=0)).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (codes >> level) & 1
            self.levels.append(BitVector(bit.astype(np.uint8)))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    def count(self, symbol: np.ndarray, i: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``i``; ``start`` is where its leaf begins."""
        for depth, level in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            ones = level.ones(i)
            i = np.where(one, level.zeros + ones, i - ones)
        return i - start

    def starts(self, symbols: int) -> np.ndarray:
        every = np.arange(symbols)
        return self.count(every, np.zeros(symbols, dtype=np.int64), np.zeros(symbols, dtype=np.int64))


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols, by doubling."""
    rank, step = codes.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = new
        if new[-1] + 1 == len(new):
            break
        step *= 2
    return order


class Index:
    """FM-index of a text whose last symbol is 0; finds patterns of at most ``depth`` symbols."""

    def __init__(self, codes: np.ndarray, symbols: int, depth: int):
        self.order = suffix_order(codes, depth)
        self.tree = WaveletTree(codes[self.order - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=symbols))])
        self.leaf = self.tree.starts(symbols)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns with ``symbol`` put before them."""
        begin, leaf = self.first[symbol], self.leaf[symbol]
        return begin + self.tree.count(symbol, low, leaf), begin + self.tree.count(symbol, high, leaf)

    def search(self, codes: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(statistic, low, high) of the patterns of ``length`` symbols that stop at ``end`` in ``codes``:
        symbols matched until done or until one occurrence is left, and the range of suffixes then."""
        low, high = self.first[codes[end - 1]], self.first[codes[end - 1] + 1]
        matched = np.ones(len(end), dtype=np.int64)
        live = np.flatnonzero(high - low > 1)
        for step in range(2, length + 1):
            if not len(live):
                break
            low[live], high[live] = self.extend(codes[end[live] - step], low[live], high[live])
            matched[live] = step
            live = live[high[live] - low[live] > 1]
        return matched, low, high


def repeats(doc: np.ndarray, place: np.ndarray, bodies: list[bytes],
            span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to) of every window of ``span`` words in the contexts whose words also start in a
    context of a smaller doc."""
    raw = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    starts, ends, first = word_spans(raw, offsets)
    words, codes = np.unique(word_hashes(raw, starts, ends), return_inverse=True)
    size = np.diff(first)
    # Symbols: 0 ends the text, 1 a context, the words follow.
    row = np.repeat(np.arange(len(size)), size)
    begin = first[:-1] + np.arange(len(size))
    text = np.ones(len(codes) + len(size) + 1, dtype=np.int64)
    text[np.arange(len(codes)) + row] = codes + 2
    text[-1] = 0
    index = Index(text, len(words) + 2, span)
    none = np.iinfo(np.int64).max                          # one more at the end closes the last range
    owner = np.append(np.append(np.repeat(doc, size + 1), none)[index.order], none)
    many = np.maximum(size - span + 1, 0)
    of = np.repeat(np.arange(len(size)), many)
    at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    # Equal windows are searched once.
    total, down = sums(text.astype(np.uint64))
    _, one, which = np.unique(digest(total, down, at, at + span), return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    for lo in range(0, len(one), QUERIES):
        part = at[one[lo:lo + QUERIES]]
        matched, low, high = index.search(text, part + span, span)
        hit = np.flatnonzero((matched == span) & (high - low > 1))
        if len(hit):
            ranges = np.stack([low[hit], high[hit]], axis=1).ravel()
            least[lo + hit] = np.minimum.reduceat(owner, ranges)[::2]
    later = least[which] < doc[of]
    a = place[of] + at - begin[of]
    return doc[of][later], a[later], a[later] + span


def word_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(raw, offsets)
    return word_hashes(raw, starts, ends), first


class Words:
    """Result columns of a text without the words of some stretches."""
    names = ["n_words", "n_removed", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.string()]
    schema = ["n_words long", "n_removed long", "kept_sha256 string"]

    def __call__(self, body: bytes, a: np.ndarray, b: np.ndarray) -> tuple:
        words = body.split()                               # at ASCII white space
        kept, at = [], 0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            kept += words[at:x]
            at = y
        kept += words[at:]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    @staticmethod
    def cut(body: bytes, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        words = body.split()
        return [b" ".join(words[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def remove_repeated_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", span: int = SPAN,
                          width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one
    space).

    A word goes if a window of ``span`` consecutive words over it also starts in a document with a smaller
    id.  A null text has no words.  A document without an id is neither cut nor a source; rows that
    repeat an id do not count as earlier than each other.  Other columns are ignored; an empty
    table gives an empty result.
    """
    scheme = Scheme(span, width, True, word_codes)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    finish = Words()
    marked = marked_documents(named, scheme, finish)
    return removed(marked, scheme, lambda d, p, b: repeats(d, p, b, span), finish, shard_bytes)
