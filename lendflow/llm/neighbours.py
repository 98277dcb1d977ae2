"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised on its own, so a pair of centroids is one
cell of a grid.  A query meets the cells in order of summed distance (here: the negative inner products
with the two centroids) by a heap over tiles of centroid pairs, until the cells hold enough candidates; those are
ranked by the exact inner product in double precision.

The centroids are fitted on at most ``SAMPLE`` vectors (in order of a hash of the id); every vector is
indexed.  Cells are laid out in blocks of about ``BLOCK`` rows, a larger cell over several blocks, and a
query goes once to each block that holds cells it visits; queries come in blocks as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lendflow.llm.common import stored

TOP = 20
SAMPLE = 20_000
MOST_CENTROIDS = 128                 # of a half: at most 128 * 128 = 16,384 cells, so cell tables are bounded
SHARE = 0.4                          # of all vectors that a query's cells hold at least
LEAST = 5_000                        # and candidates at least
BLOCK = 4096                         # rows of an index block
QUERY_BLOCK = 4096
ROUNDS = 12
TILE = 8                             # centroid pairs of a half that enter the heap together
STEP = 256                           # queries compared with a block at a time


def vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vec) without vectors that are null, empty, zero or hold a null or non-finite component."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))
                   & F.exists(v, lambda x: x != 0)))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centroids(rows: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's iterations from evenly spaced rows; a centroid that loses its rows stays where it is."""
    c = rows[np.linspace(0, len(rows) - 1, count).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(rows, c)
        size = np.bincount(near, minlength=count)
        total = np.zeros_like(c)
        np.add.at(total, near, rows)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def nearest(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (rows.astype(np.float64) @ c.T), axis=1)


def visit(near: list[np.ndarray], sizes: np.ndarray, enough: int, tile: int = 1) -> list[int]:
    """Cells in order of summed distance until they hold ``enough`` rows: a heap over the grid of the two halves' sorted
    centroids, where a tile of ``tile`` x ``tile`` neighbouring pairs, named by its nearest one, enters when both its
    predecessors have left.  Tiles are taken whole."""
    k = len(near[0])
    order = [np.argsort(x, kind="stable") for x in near]
    d = [x[o][::tile].tolist() for x, o in zip(near, order, strict=True)]
    names = order[0][:, None] * k + order[1]
    n, edge = len(d[0]), np.arange(0, k, tile)
    held_in = np.add.reduceat(np.add.reduceat(sizes[names], edge, axis=0), edge, axis=1).tolist()
    heap, out_of, cells, held = [(d[0][0] + d[1][0], 0, 0)], [0] * n, [np.zeros(0, np.int64)], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        out_of[i] = j + 1                                  # tiles of row i that have left
        if held_in[i][j]:
            cells.append(names[i * tile:(i + 1) * tile, j * tile:(j + 1) * tile].ravel())
            held += held_in[i][j]
        if j + 1 < n and (i == 0 or out_of[i - 1] > j + 1):
            heapq.heappush(heap, (d[0][i] + d[1][j + 1], i, j + 1))
        if i + 1 < n and (j == 0 or out_of[i + 1] == j):
            heapq.heappush(heap, (d[0][i + 1] + d[1][j], i + 1, j))
    found = np.concatenate(cells)
    return found[sizes[found] > 0].tolist()


def layout(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbours share a block until it is full, and a
    cell larger than a block has blocks of its own."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // block))
    at = room = 0
    for c, n in enumerate(sizes.tolist()):
        if n > block or n > room:
            at += 1
            room = block
        first[c] = at
        at += int(parts[c]) - 1
        room = 0 if n > block else room - n
    return first, parts


def best(q: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, seen: np.ndarray,
         top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``top`` rows by inner product among those it has ``seen`` (queries x rows), ties
    to the smaller id.  Scores are summed row by row, so equal vectors get equal scores wherever they stand."""
    rough = q @ rows.T
    rough[~seen | (own[:, None] == ids)] = -np.inf
    edge = np.full(len(q), -np.inf)
    if len(ids) > top:
        edge = np.partition(rough, len(ids) - top, axis=1)[:, len(ids) - top]
    slack = 1e-9 * np.abs(q).sum(1) * float(np.abs(rows).max(initial=0.0))
    query, row = np.nonzero((rough >= (edge - slack)[:, None]) & (rough > -np.inf))
    exact = (rows[row] * q[query]).sum(1)
    order = np.lexsort((ids[row], -exact, query))
    query, row, exact = query[order], row[order], exact[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < top
    return query[first], row[first], exact[first]


def search(table: DataFrame, every: int = 20, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding",
           share: float = SHARE, least: int = LEAST, sample: int = SAMPLE, block: int = BLOCK,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, a row whose id is divisible by ``every``, its
    ``top`` rows of largest inner product among those its cells hold, nearest first, ties to the smaller
    id; all of them, if fewer.

    A vector that is null, zero or holds a null or non-finite component takes no part, nor does one
    without an id or of another dimension than the sample's commonest.  Rows that repeat a query's id
    are not its candidates.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = vectors(table, vec_id, embedding)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()["vec"].combine_chunks()
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = chosen.value_lengths().to_numpy()
    dim = int(np.bincount(lengths).argmax())
    half = (dim + 1) // 2
    fit = matrix(chosen.filter(pa.array(lengths == dim))).astype(np.float64)
    rows = rows.where(F.size("vec") == dim)
    total = rows.count()
    count = int(min(MOST_CENTROIDS, len(fit), max(2, 1 << round(np.log2(max(4.0, np.sqrt(total / 4)))))))
    books = [centroids(fit[:, :half], count), centroids(fit[:, half:], count) if dim > 1 else np.zeros((count, 0))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                cell = nearest(x[:, :half], books[0]) * count + nearest(x[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "vec", "cell"])

    kind = dict(rows.dtypes)["vec"]
    index = stored(rows.mapInArrow(assign, f"vec_id long, vec {kind}, cell long"), "cells")
    sizes = np.zeros(count * count, np.int64)
    for cell, n in index.groupBy("cell").agg(F.count(F.lit(1))).collect():           # at most 16,384 rows
        sizes[cell] = n
    first, parts = layout(sizes, block)
    places = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in np.flatnonzero(sizes).tolist()],
                                   "cell long, first long, parts long")
    enough = max(least, int(share * total))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's row for each block it must see, with its cells there."""
        for batch in batches:
            x = matrix(batch.column(1)).astype(np.float64) if batch.num_rows else np.zeros((0, dim))
            blocks, asks, cells = [], [], []
            for i in range(batch.num_rows):
                near = [-(books[0] @ x[i, :half]), -(books[1] @ x[i, half:])]
                own = np.sort(np.array(visit(near, sizes, enough, TILE), dtype=np.int64))
                # A large cell has several blocks, and a block several cells.
                each = np.repeat(own, parts[own])
                block = np.repeat(first[own], parts[own]) + np.arange(len(each)) - np.repeat(
                    np.cumsum(parts[own]) - parts[own], parts[own])
                order = np.argsort(block, kind="stable")
                cut = np.flatnonzero(np.diff(block[order], prepend=-1))
                blocks.append(block[order][cut])
                asks.append(np.full(len(cut), i))
                cells += [c.astype(np.int32).tobytes() for c in np.split(each[order], cut[1:])]
            if blocks:
                at = pa.array(np.concatenate(asks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(blocks)), batch.column(0).take(at), batch.column(1).take(at),
                     pa.array(cells, type=pa.binary())], names=["block", "query_id", "query", "cells"])

    asked = index.where(F.col("vec_id") % every == 0)
    turns = max(1, -(-asked.count() // query_block))
    queries = (asked.select("vec_id", "vec").mapInArrow(route, f"block long, query_id long, query {kind}, cells binary")
               .withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns))))
    entries = (index.join(F.broadcast(places), "cell")                                 # at most 16,384 rows
               .withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")))
               .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))
               .select("block", "turn", "vec_id", "cell", "vec"))

    def compare(key, stock: pa.Table, asks: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if stock.num_rows and asks.num_rows:
            x = matrix(stock["vec"].combine_chunks()).astype(np.float64)
            ids = stock["vec_id"].to_numpy()
            names, cell = np.unique(stock["cell"].to_numpy(), return_inverse=True)
            q = matrix(asks["query"].combine_chunks()).astype(np.float64)
            own, cells = asks["query_id"].to_numpy(), asks["cells"].to_pylist()
            for lo in range(0, len(q), STEP):
                part = slice(lo, lo + STEP)
                seen = np.stack([np.isin(names, np.frombuffer(c, dtype=np.int32)) for c in cells[part]])[:, cell]
                query, row, score = best(q[part], own[part], x, ids, seen, top)
                found.append((own[part][query], ids[row], score))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)),
                                 strict=True)))

    scored = (entries.groupBy("block", "turn").cogroup(queries.groupBy("block", "turn"))
              .applyInArrow(compare, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (scored.withColumn("rank", rank).where(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
