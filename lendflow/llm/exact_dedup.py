"""Exact duplicate removal with an extendible-hash index kept as shared files.

Every text is normalised (ASCII white space deleted) and hashed to a 64-bit key.  The index holds one
entry per distinct text.  Its directory starts with one bucket; a bucket with more entries than
``capacity`` is split by one more key bit, which doubles the directory, until no bucket is overfull or
``max_depth`` bits are used.  Entries are written to the shared folder sorted by bucket and key, so that
each task owns a range of keys.  Texts with the same key chain behind each other: entries are formed by
grouping on (key, bytes of the text), which compares the bytes, and numbered within the key.

Copies meet first inside each map task (partial aggregation), so a text that makes up a third of all
rows reaches its owner as one row per map task.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lendflow.llm.common import SPACE, stored

MAX_DEPTH = 12                       # directory of at most 2^12 = 4,096 entries: bounded, so broadcast
CAPACITY = 50_000                    # entries in a bucket before it splits



def normalise(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


_SPAN = "100000000000000000000"       # 10^20, wider than any 64-bit id
_LOWEST = "9223372036854775808"      # 2^63: shifts a signed id to a non-negative number


def _wide(value: str | Column) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("decimal(38,0)")


def _precedence(code_points: Column, doc_id: Column) -> Column:
    """One sortable number: more code points first, then the smaller id (a null id comes last).  A
    fixed-width value, so the maximum stays in a hash aggregate instead of sorting whole texts."""
    after = F.coalesce(_wide(_SPAN) - 1 - (_wide(doc_id) + _wide(_LOWEST)), _wide("0"))
    return (code_points.cast("decimal(12,0)") * F.lit(_SPAN).cast("decimal(21,0)") + after).cast("decimal(38,0)")


def _id_of(precedence: Column) -> Column:
    after = F.pmod(precedence, _wide(_SPAN))
    return F.when(after > 0, (_wide(_SPAN) - 1 - after - _wide(_LOWEST)).cast("long"))


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(prefix, depth, bucket) for each ``max_depth``-bit key prefix in use, at most 2^max_depth rows.

    ``depth`` is the number of bits at which the prefix's bucket stopped splitting and ``bucket`` the
    first prefix that shares it.
    """
    counts = entries.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    # Every level of the doubling at once: the buckets a prefix falls in at 0, 1, ... bits.
    levels = counts.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    start = F.col("prefix") - F.expr(f"pmod(prefix, cast(shiftleft(1L, {max_depth} - depth) as long))")
    levels = levels.withColumn("bucket", start)
    sizes = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("size"))
    fits = (F.col("size") <= capacity) | (F.col("depth") == max_depth)
    leaves = F.broadcast(sizes.where(fits))                             # at most 2^(max_depth + 1) rows
    return (levels.join(leaves, ["depth", "bucket"])
            .groupBy("prefix").agg(F.min(F.struct("depth", "bucket")).alias("leaf"))
            .select("prefix", "leaf.depth", "leaf.bucket"))


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Write the index and return it: bucket, depth, key, chain (position among texts of one key),
    chain_length, sha (of the normalised text), keep_id, group_size."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalise(F.col(text)).alias("body"),
                       F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("code_points"))
    groups = (rows.withColumn("key", F.xxhash64("body"))
              .withColumn("precedence", _precedence(F.col("code_points"), F.col("doc_id")))
              .groupBy("key", "body")
              .agg(F.max("precedence").alias("best"), F.count(F.lit(1)).alias("group_size")))
    entries = groups.select(
        "key", F.unhex(F.sha2("body", 256)).alias("sha"),
        _id_of(F.col("best")).alias("keep_id"), "group_size",
        F.shiftrightunsigned(F.col("key"), 64 - max_depth).alias("prefix"))
    entries = stored(entries, "dedup-entries")
    leaves = F.broadcast(directory(entries, capacity, max_depth))       # at most 2^max_depth rows
    chain = Window.partitionBy("key")
    placed = (entries.join(leaves, "prefix")
              .withColumn("chain", F.row_number().over(chain.orderBy("sha")))
              .withColumn("chain_length", F.count(F.lit(1)).over(chain))
              .drop("prefix")
              .repartitionByRange(F.col("bucket"), F.col("key"))
              .sortWithinPartitions("bucket", "key", "chain"))
    return stored(placed, "dedup-index")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical without ASCII white space (a null text is empty).  Of equal texts the
    row with the most code points in its original text stays, then the smallest doc_id; a null doc_id
    comes last and ``keep_id`` is null only if the whole group has none.  ``kept`` is doc_id = keep_id
    (null ids compare equal); rows that repeat a doc_id with equal texts all carry the same answer.
    Other columns of ``docs`` are ignored.  An empty input gives an empty result.
    """
    index = build_index(docs, text, doc_id, capacity, max_depth)
    found = probe(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), index)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"),
                        "bucket", "chain")


def probe(docs: DataFrame, index: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with its entry's columns in place of the text: the key finds the chain, the digest the
    entry of the chain."""
    rows = docs.withColumn("body", normalise(F.col(text))).drop(text)
    rows = rows.withColumn("key", F.xxhash64("body")).withColumn("sha", F.unhex(F.sha2("body", 256))).drop("body")
    return rows.join(index, ["key", "sha"]).withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id")))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
             max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns whatever these are called.  Rows that repeat
    a doc_id with an equal text are one document: they stay or go together."""
    index = build_index(docs, text, doc_id, capacity, max_depth)
    body = normalise(F.col(text))
    # One packed column beside the probe's own, so that no name can clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"),
                         F.xxhash64(body).alias("key"), F.unhex(F.sha2(body, 256)).alias("sha"))
    found = packed.join(index, ["key", "sha"]).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return found.select("row.*")
