"""Near-duplicate documents by HyperMinHash signatures.

A document's set holds its distinct runs of ``width`` words.  Its signature has one 16-bit register per
bucket: the leading zeros of the smallest hash that fell in the bucket and the mantissa bits below them.
Documents that share a band of registers form families (connected components over the bands, so a band
held by thousands of documents costs one link each, not all pairs).  Inside a family, pairs that are not
yet connected are first compared by the collision-corrected estimate from their registers, and what may
reach the threshold is confirmed on the full sets.  A task emits only a spanning forest of its confirmed
links, which is all that reachability needs.

Documents with equal sets are collapsed before any of this.  A family larger than a block is compared
block against block in separate tasks, so no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendflow.llm.common import mix64, shingle_hashes, stored, text_slices, word_hashes, word_spans
from lendflow.llm.components import connected_components

BANDS = 32
MISS = 5e-6                          # chance that a pair at the threshold shares no band, at most
MANTISSA = 10                        # bits kept below the leading one
EMPTY = 0xFFFF
BORROW = 16                          # random buckets an empty one tries to copy before its neighbours
BLOCK_ROWS = 1500                    # documents of a family compared in one task
BLOCK_BYTES = 16 << 20
SIGMAS = 6.0                         # the estimate rejects a pair only so far below the threshold


def band_rows(threshold: float, bands: int = BANDS, miss: float = MISS) -> int:
    """Registers in a band: as many as keep the chance to miss a pair at the threshold within ``miss``."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct shingle hashes, and each row's first index among them (+ the total)."""
    starts, ends, first = word_spans(raw, offsets)
    h, at = shingle_hashes(word_hashes(raw, starts, ends, lower), first, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][at[:-1] < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[at]


def registers(h: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) of unsigned 16-bit registers; a row without shingles has only ``EMPTY`` ones.

    Every shingle falls in one bucket; a bucket keeps its smallest 32-bit value as the count of leading
    zeros and the ``MANTISSA`` bits below the leading one.
    """
    rows = len(at) - 1
    g = mix64(h ^ np.uint64(0xD6E8FEB86659FD93))
    bucket = ((g >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    low = np.full(rows * count, np.int64(1) << 32)
    row = np.repeat(np.arange(rows), np.diff(at))
    np.minimum.at(low, row * count + bucket.astype(np.int64), (g & np.uint64(0xFFFFFFFF)).astype(np.int64))
    zeros = 32 - np.frexp(low.astype(np.float64))[1].astype(np.int64)      # leading zeros of 32 bits
    full = low >> 32 == 1
    zeros[full] = 0
    mantissa = ((low << zeros) & 0x7FFFFFFF) >> (31 - MANTISSA)
    out = (zeros << MANTISSA) | mantissa
    out[full] = EMPTY
    return out.astype(np.uint16).reshape(rows, count)


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers whose empty buckets copy another: the first non-empty one of ``BORROW`` fixed random
    buckets, else the next non-empty one to the right.  Two sets then agree in a register with
    probability close to their similarity, however small they are."""
    out = regs.copy()
    rows, count = regs.shape
    choice = np.random.default_rng(count).integers(0, count, (BORROW, count))
    left = np.flatnonzero((regs == EMPTY).any(1) & (regs != EMPTY).any(1))
    sub, own = out[left], regs[left]
    for pick in choice:
        if not (sub == EMPTY).any():
            break
        sub = np.where(sub == EMPTY, own[:, pick], sub)
    place = np.where(own != EMPTY, np.arange(count), 3 * count)
    twice = np.concatenate([place, place + count], axis=1)
    after = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :count] % count
    sub = np.where(sub == EMPTY, np.take_along_axis(own, after, axis=1), sub)
    out[left] = sub
    return out


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) of 64-bit keys of ``rows`` registers each."""
    parts = regs.reshape(len(regs), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k].astype(np.uint64))
    return key.view(np.int64)


def estimate(one: np.ndarray, many: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one register row against many: the share of equal registers, less what
    distinct minima with the same zeros and mantissa bits contribute.  For sets of n and m elements the
    minima collide with probability n*m/(n+m)^2 / (2 ln 2) / 2^MANTISSA."""
    agree = (many == one).mean(1)
    n, m = float(size), sizes.astype(float)
    chance = n * m / (n + m) ** 2 / (2 * math.log(2)) / (1 << MANTISSA)
    return (agree - chance) / (1 - chance)


def signatures(docs: DataFrame, text: str, doc_id: str, width: int, threshold: float, lower: bool) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): the size of each set, a 128-bit digest of it, band keys."""
    rows = band_rows(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_slices(batch, "body"):
                h, at = shingle_sets(raw, offsets, width, lower)
                size, some = np.diff(at), np.diff(at) > 0
                digest = []
                for seed in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(seed)))])
                    digest.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                keys = band_keys(densified(registers(h, at, BANDS * rows)), rows)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), type=pa.int32()),
                    pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(digest[0]), pa.array(digest[1]),
                     bands], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


class Forest:
    """Components of a block's documents."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> list[int]:
        """Connect x with others; returns those of them that newly connected a component."""
        new = []
        for y in others.tolist():
            if self.label[y] != self.label[x]:
                self.label[self.label == self.label[y]] = self.label[x]
                new.append(y)
        return new


def confirmed_links(h: np.ndarray, at: np.ndarray, side: np.ndarray, threshold: float, rows: int) -> list[tuple]:
    """A spanning forest (pairs of row numbers) of the links among the rows; ``side`` (0 or 1 each)
    restricts links to rows of different sides unless all rows are on one.

    A row is compared with the rows it is not connected with: by size and estimate first, then by
    counting its shingles in each of their full sets.
    """
    size = np.diff(at)
    n = len(size)
    sparse = registers(h, at, BANDS * rows)
    regs, filled = densified(sparse), np.maximum((sparse != EMPTY).sum(1), 1)
    ids, flat = np.unique(h, return_inverse=True)
    mine = np.zeros(len(ids), dtype=bool)
    forest, links = Forest(n), []
    two = bool(side.any()) and not bool(side.all())
    percent = round(threshold * 100)
    row_of = np.repeat(np.arange(n), size)
    for x in range(n):
        later = np.arange(x + 1, n)
        ok = (forest.label[later] != forest.label[x]) & (
            np.minimum(size[later], size[x]) * 100 >= percent * np.maximum(size[later], size[x]))
        if two:
            ok &= side[later] != side[x]
        later = later[ok]
        if not len(later):
            continue
        slack = SIGMAS * math.sqrt(threshold * (1 - threshold)) / np.sqrt(np.minimum(filled[later], filled[x]))
        later = later[estimate(regs[x], regs[later], size[x], size[later]) >= threshold - slack]
        if not len(later):
            continue
        mine[flat[at[x]:at[x + 1]]] = True
        if len(later) * 4 > n:
            common = np.bincount(row_of, mine[flat], minlength=n)[later].astype(np.int64)
        else:
            common = np.array([np.count_nonzero(mine[flat[at[y]:at[y + 1]]]) for y in later.tolist()])
        mine[flat[at[x]:at[x + 1]]] = False
        union = size[x] + size[later] - common
        links += [(x, y) for y in forest.join(x, later[common * 100 >= percent * union])]
    return links


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5,
               threshold: float = 0.8, lower: bool = True, block_rows: int = BLOCK_ROWS,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= 100 * ``threshold`` * |union| of their shingle
    sets; ``component_id`` is the smallest doc_id reachable over links and ``kept`` is doc_id =
    component_id.  A text with fewer words than ``width`` has one shingle, its whole sequence; null
    texts and texts without words have none and are linked with nothing.  A null doc_id is a document
    of its own (component null, kept), linked with nothing; rows that repeat a doc_id are one document
    to the links and each give a row.  Other columns are ignored; empty in, empty out.

    Missing a link takes a pair that shares none of the bands (at the threshold, probability ``MISS``)
    or an estimate ``SIGMAS`` standard errors low, and then no other chain of links.
    """
    rows = band_rows(threshold)
    signed = stored(signatures(docs, text, doc_id, width, threshold, lower), "signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    equal = real.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    equal = stored(equal, "equal-sets")
    reps = real.join(equal.select(F.col("rep").alias("doc_id"), "set_a", "set_b", "n_shingles"),
                     ["doc_id", "set_a", "set_b", "n_shingles"]).select("doc_id", F.explode("bands").alias("band"))
    # Families: each document is linked to the smallest one that shares a band with it.
    heads = reps.groupBy("band").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("last > head")
    stars = reps.join(heads, "band").where("doc_id > head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    family = stored(connected_components(stars).withColumnRenamed("id", "doc_id"), "families")
    bodies = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
              .join(family, "doc_id").withColumn("size", F.octet_length("body").cast("long")))
    blocks = family.join(signed.select("doc_id", "n_shingles"), "doc_id").groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("shingles") * 8 / block_bytes)).cast("int")
    blocks = blocks.select("component", parts.alias("parts"))
    dealt = bodies.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                     "own", "doc_id", "body"))

    def compare(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        side = (table["own"].to_numpy() != table["low"].to_numpy()).astype(np.int64)
        sets, first = [], [np.zeros(1, np.int64)]
        for batch in table.select(["body"]).combine_chunks().to_batches():
            for _, _, raw, offsets in text_slices(batch, "body"):
                h, at = shingle_sets(raw, offsets, width, lower)
                sets.append(h)
                first.append(at[1:] + first[-1][-1])
        links = confirmed_links(np.concatenate(sets), np.concatenate(first), side, threshold, rows)
        pairs = ids[np.array(links, dtype=np.int64).reshape(-1, 2)]
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    links = dealt.groupBy("component", "low", "high").applyInArrow(compare, "a long, b long")
    linked = stored(connected_components(links), "components")
    answer = equal.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    return (signed.join(answer, ["set_a", "set_b", "n_shingles"], "left")
            .withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(),
                                               F.col("component")).otherwise(F.col("doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
