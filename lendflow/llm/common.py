"""Helpers shared by the operators: shared-folder tables, Arrow text slices, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendflow.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"          # a word: bytes other than ASCII white space
SPACE = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20                # text handled at a time inside a task (a longer text: alone)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files every executor
    (and its replacement) can read."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def u64(x: Column | str) -> Column:
    """Spread bits of a long (xxhash64 with Spark's fixed seed)."""
    return F.xxhash64(x)


def bucket_count(rows: int, per_bucket: int, least: int = 1, most: int = 1 << 20) -> int:
    """Power-of-two number of buckets that holds about ``per_bucket`` rows in each."""
    want = max(least, min(most, -(-rows // per_bucket)))
    return 1 << (want - 1).bit_length()


# --- text inside tasks -----------------------------------------------------------------------------
def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column, nulls as empty, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def text_slices(batch: pa.RecordBatch, column: str,
                limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` text bytes (at least one row): (first row, end row, bytes,
    offsets into these bytes)."""
    raw, offsets = string_buffer(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)                      # odd, so it has an inverse mod 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_POWERS["up"])
    if have < n:
        size = max(n, 2 * have, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            full = np.full(size, base, dtype=np.uint64)
            full[0] = 1
            _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(raw: np.ndarray, offsets: np.ndarray,
               letters: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (run of ``letters`` bytes), and for each row the index of its
    first word (+ the total)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = letters[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True                                    # rows never share a word
    first = ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit polynomial hash of each word's bytes, mixed with its length; ``lower`` folds A-Z."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw] if lower else raw).astype(np.uint64) * up[:-1] + up[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


def word_prefix_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                       lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the whole words and of their first ``lengths`` bytes, A-Z folded."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[raw].astype(np.uint64) * up[:-1] + up[:-1], out=total[1:])
    before, scale = total[starts], down[starts]
    return [(total[e] - before) * scale for e in (ends, *(np.minimum(starts + k, ends) for k in lengths))]


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``width`` words (one for a shorter, non-empty row) and each row's
    first index among them (+ the total)."""
    counts = np.diff(first)
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    out_first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    at = first[:-1][row] + (np.arange(out_first[-1]) - out_first[:-1][row])
    stop = first[1:][row]
    h = np.full(len(at), np.uint64(0x2545F4914F6CDD1D))
    for k in range(width):
        there = at + k < stop
        w = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else h
        h = np.where(there, mix64(h ^ w) + np.uint64(k + 1), h)
    return h, out_first
