"""Repeated byte strings by induced suffix sorting.

Documents are narrowed to the contexts that can hold a partial repeat (see ``anchors``); a shard of
contexts is one text, whose suffixes are put in order by induced sorting:

1. the leftmost S-type suffixes are put in order by their substrings (a first induction) and the reduced
   string of the substrings' names, by doubling up to the depth that matters;
2. a scan in increasing order induces the L-type suffixes, a scan in decreasing order the S-type ones.

What a scan induces goes to one queue per first symbol as (suffix, common prefix with the queue's last
entry).  Entries enter a queue already in order, so a queue is a priority queue whose head is read in
blocks; blocks beyond a memory budget are kept in one unnamed file that ends with the task.  The common
prefix of two induced suffixes is one more than the least common prefix scanned between the suffixes that
induced them.  Suffixes whose common prefixes reach the span form groups of equal strings; all members
but the earliest are repeats.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendflow.llm.anchors import Scheme, digest, marked_documents, removed, sums

SPAN = 100                           # bytes of a repeat
WIDTH = 40                           # bytes of an anchor's gram
SHARD_BYTES = 2 << 20
QUEUE_BYTES = 64 << 20               # queue blocks held in memory
BLOCK = 1 << 20                      # entries read from a queue at a time, about
_END, _BREAK = 0, 1                  # end of the text, end of a context; bytes follow


class Queues:
    """First-in first-out queues of (suffix, common prefix) blocks, spilled beyond ``budget`` bytes."""

    def __init__(self, count: int, budget: int = QUEUE_BYTES):
        self.blocks = [deque() for _ in range(count)]
        self.last = np.full(count, -1, dtype=np.int64)
        self.held, self.budget, self.file = 0, budget, None

    def push(self, queue: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.last[queue] = at[-1]
        size = at.nbytes + lcp.nbytes
        if self.held + size <= self.budget:
            self.held += size
            self.blocks[queue].append((at, lcp))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()            # within this task only, like a sort's spill
        where = self.file.seek(0, 2)
        self.file.write(at.tobytes())
        self.file.write(lcp.tobytes())
        self.blocks[queue].append((where, len(at)))

    def take(self, queue: int) -> tuple[np.ndarray, np.ndarray] | None:
        """What a queue holds now, up to ``BLOCK`` entries, in order; None when it is empty."""
        found, size = [], 0
        waiting = self.blocks[queue]
        while waiting and size < BLOCK:
            a, b = waiting.popleft()
            if isinstance(a, np.ndarray):
                self.held -= a.nbytes + b.nbytes
            else:
                self.file.seek(a)
                a, b = (np.frombuffer(self.file.read(8 * b), dtype=np.int64),
                        np.frombuffer(self.file.read(b), dtype=np.uint8))
            found.append((a, b))
            size += len(a)
        if not found:
            return None
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]


class Induction:
    """Suffix order of ``text`` (symbols 0 .. symbols - 1, the last one 0 and alone) up to ``depth``."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, budget: int = QUEUE_BYTES):
        self.text, self.symbols, self.depth, self.budget = text, symbols, depth, budget
        n = len(text)
        turn = np.flatnonzero(text[1:] != text[:-1])       # last places of runs of equal symbols
        run_end = turn[np.searchsorted(turn, np.arange(n - 1))]
        self.small = np.ones(n, dtype=bool)                 # S-type: below its successor
        self.small[:-1] = text[run_end] < text[run_end + 1]
        self.seeds = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.total, self.down = sums(text.astype(np.uint64))

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common prefix lengths up to ``depth``, by bisection over digests."""
        n = len(self.text)
        top = np.minimum(self.depth, n - np.maximum(p, q))
        low, high = np.zeros_like(p), top
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = digest(self.total, self.down, p, p + mid) == digest(self.total, self.down, q, q + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low.astype(np.uint8)

    def seed_order(self) -> np.ndarray:
        """The seeds' suffixes in order up to ``depth`` symbols."""
        seeds = self.seeds
        if len(seeds) < 2:
            return seeds
        first = seeds[np.argsort(self.text[seeds], kind="stable")]
        is_seed = np.zeros(len(self.text), dtype=bool)
        is_seed[seeds] = True
        # By substrings up to the next seed.
        order = np.concatenate([at[is_seed[at]] for at, _ in self.scan(first, None)])[::-1]
        follow = np.full(len(self.text), len(self.text) - 1)
        follow[seeds[:-1]] = seeds[1:]
        size = follow[order] - order + 1
        name = digest(self.total, self.down, order, order + size)
        rank_of = np.zeros(len(self.text), dtype=np.int64)
        rank_of[order] = np.concatenate([[0], np.cumsum((name[1:] != name[:-1]) | (size[1:] != size[:-1]))])
        rank, step = rank_of[seeds], 1
        # Seeds are at least two symbols apart: so many names reach the depth.
        while step * 2 <= self.depth * 2 and rank.max() + 1 < len(rank):
            ahead = np.zeros(len(rank), dtype=np.int64)
            ahead[:-step] = rank[step:] + 1
            key = rank * (len(rank) + 1) + ahead
            by = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[by][1:] != key[by][:-1])])
            rank = np.empty(len(by), dtype=np.int64)
            rank[by] = new
            step *= 2
        return seeds[np.argsort(rank, kind="stable")]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in decreasing order as blocks (suffix, common prefix with the one before)."""
        seeds = self.seed_order()
        lcp = np.zeros(len(seeds), dtype=np.uint8)
        if len(seeds) > 1:
            lcp[1:] = self.common(seeds[:-1], seeds[1:])
        return self.scan(seeds, lcp)

    def scan(self, seeds: np.ndarray, lcp: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        text, last_at = self.text, -1
        lcp = np.zeros(len(seeds), dtype=np.uint8) if lcp is None else lcp
        bounds = np.searchsorted(text[seeds], np.arange(self.symbols + 1))
        large, done = Queues(self.symbols, self.budget), Queues(self.symbols, self.budget)
        least = np.zeros(self.symbols, dtype=np.uint8)
        for c in range(self.symbols):                       # increasing: the L-type suffixes
            last_at = -1
            while (block := large.take(c)) is not None:
                done.push(c, *block)
                last_at = block[0][-1]
                self.induce(*block, large, least, small=False)
            lo, hi = bounds[c], bounds[c + 1]
            if lo < hi:
                own = lcp[lo:hi].copy()
                own[0] = self._pair(last_at, seeds[lo])
                self.induce(seeds[lo:hi], own, large, least, small=False)
        small = Queues(self.symbols, self.budget)
        small.push(0, np.array([len(text) - 1]), np.zeros(1, dtype=np.uint8))
        least = np.zeros(self.symbols, dtype=np.uint8)
        for c in range(self.symbols - 1, -1, -1):           # decreasing: the S-type ones
            last_at = -1
            while (block := small.take(c)) is not None:
                last_at = block[0][-1]
                yield block
                self.induce(*block, small, least, small=True)
            parts = []
            while (block := done.take(c)) is not None:
                parts.append(block)
            at_next = None
            for at, own in reversed(parts):
                down = np.empty_like(own)
                down[1:] = own[:0:-1]
                down[0] = self._pair(last_at, at[-1]) if at_next is None else at_next
                at_next = own[0]
                yield at[::-1], down
                self.induce(at[::-1], down, small, least, small=True)

    def _pair(self, p: int, q: int) -> int:
        return int(self.common(np.array([p]), np.array([q]))[0]) if p >= 0 else 0

    def induce(self, at: np.ndarray, lcp: np.ndarray, queues: Queues, least: np.ndarray, small: bool) -> None:
        """Queue the wanted type's suffixes one symbol to the left of a scanned block.  ``least`` holds, for
        each queue, the least common prefix scanned since its last entry."""
        pick = np.flatnonzero(at > 0)
        pick = pick[self.small[at[pick] - 1] == small]
        to = self.text[at[pick] - 1]
        order = np.argsort(to, kind="stable")
        pick, to = pick[order], to[order]
        low = lcp.min()
        if len(pick):
            head = np.ones(len(pick), dtype=bool)
            head[1:] = to[1:] != to[:-1]
            start = np.where(head, 0, np.concatenate([[0], pick[:-1] + 1]))
            ranges = np.stack([start, pick + 1], axis=1).ravel()
            shared = np.minimum.reduceat(np.append(lcp, np.uint8(255)), ranges)[::2]
            shared[head] = np.minimum(shared[head], least[to[head]])
            mine = np.minimum(shared, self.depth - 1) + np.uint8(1)
            mine[head] = np.where(queues.last[to[head]] < 0, 0, mine[head])
            tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
        np.minimum(least, low, out=least)
        if len(pick):
            starts = np.flatnonzero(head)
            stops = np.append(starts[1:], len(pick))
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                queues.push(int(to[a]), at[pick[a:b]] - 1, mine[a:b])
                least[to[a]] = tail[pick[b - 1] + 1]


def whole_groups(blocks: Iterator[tuple[np.ndarray, np.ndarray]],
                 span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffix, group) of the ordered blocks in pieces of about ``BLOCK`` entries; a group of suffixes with
    a common prefix of ``span`` is in one piece."""
    held, size = [], 0
    for at, lcp in blocks:
        new = lcp < span
        size += len(at)
        starts = np.flatnonzero(new) if size >= BLOCK else new[:0]
        if len(starts):
            cut = int(starts[-1])
            piece, heads = (np.concatenate(x) for x in zip(*held, (at[:cut], new[:cut]), strict=True))
            if len(piece):
                yield piece, np.cumsum(heads) - 1
            at, new, held = at[cut:], new[cut:], []
            size = len(at)
        held.append((at, new))
    piece, heads = (np.concatenate(x) for x in zip(*held, strict=True))
    yield piece, np.cumsum(heads) - 1


def repeats(doc: np.ndarray, place: np.ndarray, bodies: list[bytes], span: int = SPAN,
            budget: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to) of every ``span``-byte string in the contexts that an earlier one (smaller doc, or
    same doc and earlier place) equals."""
    size = np.array([len(b) for b in bodies], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(first[-1] + 1, _BREAK, dtype=np.int16)
    text[-1] = _END
    for a, body in zip(first.tolist(), bodies, strict=False):
        text[a:a + len(body)] = np.frombuffer(body, dtype=np.uint8).astype(np.int16) + 2
    found = []
    for at, group in whole_groups(Induction(text, 258, span, budget).blocks(), span):
        row = np.searchsorted(first, at, side="right") - 1
        row = np.minimum(row, len(size) - 1)
        ok = at + span <= first[row] + size[row]            # whole strings of one context
        ok &= np.bincount(group[ok], minlength=int(group[-1]) + 1)[group] > 1
        at, group, row = at[ok], group[ok], row[ok]
        who, where = doc[row], place[row] + at - first[row]
        order = np.lexsort((where, who, group))
        who, where, group = who[order], where[order], group[order]
        head = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1])[:len(group)],
                                              np.arange(len(group)), 0))
        later = (who != who[head]) | (where != where[head])
        found.append((who[later], where[later]))
    who, where = (np.concatenate(x) for x in zip(*found, strict=True))
    return who, where, where + span


def byte_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw.astype(np.uint64), offsets


class Bytes:
    """Result columns of a text without the bytes of some stretches."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    schema = ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"]

    def __call__(self, body: bytes, a: np.ndarray, b: np.ndarray) -> tuple:
        kept = hashlib.sha256()
        at = 0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            kept.update(body[at:x])
            at = y
        kept.update(body[at:])
        return len(body), int((b - a).sum()), len(a), kept.hexdigest()

    @staticmethod
    def cut(body: bytes, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        return [body[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def remove_repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", span: int = SPAN,
                          width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    Texts are UTF-8 bytes (null: empty).  A byte goes if a ``span``-byte string over it also starts
    earlier: in a document with a smaller id, or earlier in the same one.  A document without an id is
    neither cut nor a source; rows that repeat an id are read as one document if their texts are equal
    and are each compared with the other ids' texts otherwise.  Other columns are ignored; an empty
    table gives an empty result.
    """
    scheme = Scheme(span, width, False, byte_codes)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    finish = Bytes()
    marked = marked_documents(named, scheme, finish)
    return removed(marked, scheme, lambda d, p, b: repeats(d, p, b, span), finish, shard_bytes)
