"""Exact k-nearest-neighbour join that leaves out what cannot be near.

Corpus rows belong to their nearest pivot.  A cell knows how near and how far its rows are from the pivot, so the
triangle inequality bounds from below the distance of a query to every row of the cell; so does the plane
halfway to any other pivot.  In the first round a query meets the cells that seem nearest, as many as hold k rows;
its k-th distance then bounds the answer from above, and in the second it meets every other cell whose lower
bound does not exceed that.  Results equal ``knn``; how much is left out depends on the data: most pairs of
clustered vectors, none of vectors that are all about equally far apart.

Other metrics become distances first (``metric_space``).  To the driver come only the pivots (at most
``MAX_PIVOTS``) and one row of radii and counts per cell.  Cells, and queries by the cell that seems nearest, are cut into
blocks of ``block_rows`` rows, each written once as a row.  Blocks meet in a Cartesian product that reads both sides again, and only
where a query of the one asks for the cell of the other: no vector is copied for every cell it meets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendflow.operators.knn import KNN_SCHEMA, best_of, meet, n_blocks, top_k
from lendflow.session import materialize

MAX_PIVOTS = 256
SLACK = 1e-9                 # of the largest distance: what rounding may take from a bound
METRICS = ("l2", "cosine", "inner")
_STEP = 1 << 20              # numbers in the work array of the plane bounds


def _squares(vec) -> F.Column:
    return F.aggregate(vec, F.lit(0.0), lambda total, x: total + x * x)


def metric_space(queries: DataFrame, corpus: DataFrame, metric: str):
    """(queries, corpus, back): (id, vec) rows of either side as points whose squared distances order as the metric does,
    and the function that turns hits back into it.

    ``l2``: as they are.  ``cosine``: unit length, squared distance = 2 (1 - cosine); zero vectors have no direction
    and take no part.  ``inner``: one more coordinate lifts all corpus rows to the largest norm, so the
    squared distance is |q|^2 + norm^2 - 2 q.c."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    if metric == "l2":
        return queries, corpus, lambda hits: hits
    if metric == "cosine":
        def unit(df):
            return (df.withColumn("_n", F.sqrt(_squares("vec"))).where("_n > 0")
                    .select("id", F.transform("vec", lambda x: x / F.col("_n")).alias("vec")))
        return unit(queries), unit(corpus), lambda hits: hits.withColumn("distance", F.col("distance") / 2)
    top = corpus.agg(F.max(_squares("vec")).alias("top")).first().top or 0.0
    lifted = corpus.select("id", F.concat("vec", F.array(F.sqrt(F.greatest(F.lit(top) - _squares("vec"), F.lit(0.0))))).alias("vec"))
    flat = queries.select("id", F.concat("vec", F.array(F.lit(0.0))).alias("vec"))
    norms = queries.select(F.col("id").alias("query_id"), _squares("vec").alias("_q"))

    def back(hits: DataFrame) -> DataFrame:
        return hits.join(norms, "query_id").withColumn(
            "distance", (F.col("distance") - F.col("_q") - F.lit(top)) / 2).drop("_q")
    return flat, lifted, back


# --- bounds -------------------------------------------------------------------------------------------
def _points(vectors: pa.Array, dim: int) -> np.ndarray:
    offsets = vectors.offsets.to_numpy()
    return vectors.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _to_pivots(X: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points to pivots, each summed from differences: no cancellation near a pivot."""
    out = np.empty((len(X), len(pivots)))
    for j, p in enumerate(pivots):
        diff = X - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


class _Cells:
    """Pivots with their cells' radii and sizes."""

    def __init__(self, pivots: np.ndarray, stats):
        self.pivots = pivots
        n = len(pivots)
        self.near, self.far, self.size = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        for s in stats:
            self.near[s.cell], self.far[s.cell], self.size[s.cell] = s.near, s.far, s.n
        self.apart = _to_pivots(pivots, pivots)

    def lower(self, X: np.ndarray) -> np.ndarray:
        """For each point and cell, a distance that no row of the cell falls short of; empty cells: infinite."""
        d = _to_pivots(X, self.pivots)
        low = np.maximum(np.maximum(d - self.far, self.near - d), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            width = np.where(self.apart > 0, 0.5 / self.apart, 0.0)
        step = max(1, _STEP // max(1, len(self.pivots)) ** 2)
        for s in range(0, len(X), step):
            sq = d[s:s + step] ** 2
            planes = (sq[:, :, None] - sq[:, None, :]) * width[None]
            low[s:s + step] = np.maximum(low[s:s + step], planes.max(axis=2))
        low -= SLACK * (1.0 + d.max(axis=1, keepdims=True))
        low[:, self.size == 0] = np.inf
        return low


def _lists(rows: np.ndarray, cells: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)),
                                    pa.array(cells.astype(np.int32)))


def _homes(cells: _Cells, need: int):
    dim = cells.pivots.shape[1]

    def home(vectors: pa.Array) -> pa.Array:
        low = cells.lower(_points(vectors, dim))
        order = np.argsort(low, axis=1, kind="stable")
        held = np.cumsum(cells.size[order], axis=1)
        rows, places = np.nonzero((held - cells.size[order] < need) & np.isfinite(np.take_along_axis(low, order, 1)))
        return _lists(rows, order[rows, places], len(low))
    return home


def _others(cells: _Cells):
    dim = cells.pivots.shape[1]

    def other(vectors: pa.Array, bounds: pa.Array, homes: pa.Array) -> pa.Array:
        low = cells.lower(_points(vectors, dim))
        bound = np.sqrt(bounds.to_numpy(zero_copy_only=False))
        open_ = np.isfinite(low) & (low <= (bound * (1 + SLACK))[:, None])
        offsets = homes.offsets.to_numpy()
        done = homes.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()
        open_[np.repeat(np.arange(len(low)), np.diff(offsets)), done] = False
        return _lists(*np.nonzero(open_), len(low))
    return other


# --- join ---------------------------------------------------------------------------------------------
def _block(cell, counts: dict[int, int], block_rows: int) -> F.Column:
    """A row's block among those of its ``cell``, which holds so many rows: a hash of the id."""
    blocks = F.array(*[F.lit(n_blocks(counts.get(i, 0), block_rows)) for i in range(max(counts, default=0) + 1)])
    return F.pmod(F.xxhash64("id"), F.element_at(blocks, cell + 1))


def _meet(asked: DataFrame, blocks: DataFrame, counts: dict[int, int], k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """k best rows of the cells each query asks for.  ``asked``: (id, vec, home, want) and, if known, the bound."""
    entry = F.struct("id", "vec", "want", *[c for c in ("bound",) if c in asked.columns])
    home = F.col("home")[0]
    rows = asked.where("size(want) > 0 AND size(home) > 0").groupBy(F.concat_ws(" ", home, _block(home, counts, block_rows)).alias("qb"))
    rows = materialize(rows.agg(F.collect_list(entry).alias("q"), F.array_distinct(F.flatten(F.collect_list("want"))).alias("cells")), "query-blocks")
    pairs = meet(rows, blocks, blocks.count()).where(F.array_contains("cells", F.col("cell")))
    return pairs.select("qb", "q", "cell", "c").mapInArrow(best_of(k, exclude_self), KNN_SCHEMA)


def pivot_search(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "vec",
                 corpus_id: str = "id", corpus_vec: str = "vec", exclude_self: bool = False, metric: str = "l2",
                 pivots: int = 64, block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(hits, pairs).  ``hits``: as ``knn`` gives them, (query_id, rank, neighbor_id, distance); the distance is squared
    (``l2``), one minus the cosine, or the negative inner product.  ``pairs``: one row (pairs_scored, pairs_all).
    Ids are unique, vectors of one length and finite; null vectors take no part."""
    def side(df, i, v):
        return df.select(F.col(i).cast("long").alias("id"), F.col(v).cast("array<double>").alias("vec")).where("vec IS NOT NULL")

    q, c, back = metric_space(side(queries, query_id, query_vec), side(corpus, corpus_id, corpus_vec), metric)
    chosen = c.orderBy(F.xxhash64("id"), "id").limit(min(pivots, MAX_PIVOTS)).collect()
    if not chosen:
        spark = corpus.sparkSession
        return (spark.createDataFrame([], "query_id long, rank int, neighbor_id long, distance double"),
                spark.createDataFrame([(0, 0)], "pairs_scored long, pairs_all long"))
    points = np.unique(np.array([r.vec for r in chosen], np.float64), axis=0)
    dim = points.shape[1]

    def nearest(vectors: pa.Array) -> pa.Array:
        d = _to_pivots(_points(vectors, dim), points)
        cell = d.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                          names=["cell", "d"])

    rows = materialize(c.withColumn("at", F.arrow_udf(nearest, "struct<cell:int,d:double>")("vec")).select("id", "vec", "at.*"), "cells")
    stats = rows.groupBy("cell").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.count(F.lit(1)).alias("n"))
    cells = _Cells(points, stats.collect())
    asked = materialize(q.withColumn("home", F.arrow_udf(_homes(cells, k + int(exclude_self)), "array<int>")("vec")), "asked")
    held = {i: int(n) for i, n in enumerate(cells.size)}
    blocks = rows.groupBy("cell", _block(F.col("cell"), held, block_rows).alias("b")).agg(F.collect_list(F.struct("id", "vec")).alias("c"))
    blocks = materialize(blocks.drop("b"), "cell-blocks")
    homes = {r.home: r.n for r in asked.where("size(home) > 0").groupBy(F.col("home")[0].alias("home")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first = asked.withColumn("want", F.col("home"))
    near = materialize(top_k(_meet(first, blocks, homes, k, exclude_self, block_rows), k), "near")
    # A query that found fewer than k rows has no bound: it meets every cell.
    bound = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("bound"))
    rest = asked.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    second = materialize(rest.withColumn("want", F.arrow_udf(_others(cells), "array<int>")("vec", "bound", "home")), "more")
    found = near.select("query_id", "neighbor_id", "distance").unionByName(_meet(second, blocks, homes, k, exclude_self, block_rows))
    met = (first.select(F.explode("want").alias("cell")).unionAll(second.select(F.explode("want").alias("cell"))).groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
           .join(stats.select("cell", "n"), "cell").select((F.col("q") * F.col("n")).alias("met"), F.lit(0).cast("long").alias("asked")))
    every = asked.select(F.lit(0).cast("long").alias("met"), F.lit(1).cast("long").alias("asked"))
    pairs = met.unionByName(every).agg(
        F.coalesce(F.sum("met"), F.lit(0)).alias("pairs_scored"),
        (F.coalesce(F.sum("asked"), F.lit(0)) * F.lit(int(cells.size.sum()))).alias("pairs_all"))
    return back(top_k(found, k)).select("query_id", "rank", "neighbor_id", "distance"), pairs


def pivot_knn(queries: DataFrame, corpus: DataFrame, k: int, **options) -> DataFrame:
    """The hits of ``pivot_search``."""
    return pivot_search(queries, corpus, k, **options)[0]
