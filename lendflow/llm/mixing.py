"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, up to ``max_epochs`` times over.  A copy's virtual
finish time is the number of tokens its source has queued up to and including it, divided by the source's
target.  All copies are then put in order of finish time and the mix is cut where its running total would
exceed the budget: at every moment each source has been served in proportion to its target.

Running totals are taken in two steps (sums of buckets, then rows inside a bucket), so a source with a
third of all rows is spread over many tasks.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lendflow.llm.common import WORD, bucket_count, stored

WEIGHTS = (3, 1, 2)                  # of the sources in code-point order, repeating
SHARE = 1.5                          # budget: share of all sizes
MAX_EPOCHS = 2                       # a source's target stops at so many times its size
PER_BUCKET = 1024                    # rows of a bucket of a running total, about
_ORDER_BITS = 60


def words(text: Column) -> Column:
    """Size of a text: its number of words (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """Place in the shuffled order: 60 bits of the id's digest, the same in every run and engine."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size) rows.

    Sources by code point (null last) weigh ``weights`` in turn and share ``share`` of all sizes.  No
    target exceeds ``max_epochs`` times its source's size; what is cut off goes to the others by weight
    until none is above.  That fixed point is one level L with targets min(cap, L * weight): sources
    are sorted by cap / weight, and L is the first level that fits under the next source's cap.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1))
    t = (sizes.withColumn("weight", weight)
         .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
         .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()).cast("double")))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    t = t.withColumn("level", level)
    # Sources before the first that stays under its cap are full; from there on the level is shared.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    whole = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("shared", F.first(fits, ignorenulls=True).over(whole))
    target = F.coalesce(F.least(F.col("cap"), F.col("shared") * F.col("weight")), F.col("cap"))
    return t.select("source", "source_size", target.alias("target"))


def running_total(rows: DataFrame, groups: list[str], bucket: str, order: list[str], size: str,
                  out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``size`` up to and including the row, by (bucket, order) within
    ``groups``.  ``bucket`` must not decrease along the order."""
    sums = rows.groupBy(*groups, bucket).agg(F.sum(size).alias("_in"))
    ahead = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).cast("long"))
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    right = sums.select(*[F.col(g).alias(f"_{g}") for g in (*groups, bucket)], "_ahead")
    match = F.lit(True)
    for g in (*groups, bucket):
        match = match & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return (rows.withColumn("_run", F.sum(size).over(inside)).join(right, match)
            .withColumn(out, F.col("_run") + F.col("_ahead"))
            .drop("_run", "_ahead", *[f"_{g}" for g in (*groups, bucket)]))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        per_bucket: int = PER_BUCKET) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` (0 to ``max_epochs``) is how often the mix takes the document and ``taken`` its words,
    copies * size.  A copy is in the queue while its source's earlier copies fall short of the target, so
    a source overshoots by less than one document; the mix ends before the copy that would exceed
    the budget.  Null texts and texts of white space have size 0 and copies 0; a null source is a source
    of its own; a null doc_id has its own fixed place in the shuffle; rows that repeat a doc_id queue
    one after the other.  Other columns are ignored.  An empty input gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       words(F.col(text)).alias("size"))
    rows = stored(rows.withColumn("place", shuffle_key(F.col("doc_id")))
                  .withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, max_epochs), "mix-targets")
    n_buckets = bucket_count(rows.count(), per_bucket)
    bits = n_buckets.bit_length() - 1
    queued = rows.where("size > 0").withColumn("part", F.shiftright("place", _ORDER_BITS - bits))
    order = ["place", "doc_id", "size", "row"]
    queued = running_total(queued, ["source"], "part", order, "size", "upto")
    queued = queued.join(targets.withColumnRenamed("source", "_source"),
                         F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = (queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
              .withColumn("upto", F.col("upto") + F.col("epoch") * F.col("source_size"))
              .where((F.col("upto") - F.col("size")).cast("double") < F.col("target"))
              .withColumn("finish", F.col("upto").cast("double") / F.col("target"))
              # Finish times lie in (0, 1] but for a source's last copy.
              .withColumn("part", F.floor(F.least(F.col("finish"), F.lit(1.0)) * n_buckets))
              .select("row", "source", "doc_id", "size", "part", "finish", "epoch"))
    served = running_total(copies, [], "part", ["finish", "source", "doc_id", "epoch", "row"], "size", "total")
    budget = F.broadcast(targets.agg((F.sum("target")).alias("budget")))             # one row
    taken = (served.join(budget, F.col("total") <= F.col("budget") + 1e-6)
             .groupBy("row").agg(F.count(F.lit(1)).alias("copies")))
    return (rows.join(taken, "row", "left")
            .join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("copies", F.coalesce("copies", F.lit(0)))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))
