"""Keyed state with a time to live: submissions already taken (Z2) and counts that follow each change (A1).

The processors hold one row of a key, however many rows a batch brings: the counts see one key at a time, the
submissions a cell of keys.  Rows that cannot matter to a key's state leave before the shuffle: within an Arrow batch
only the leading row of a key goes to it, so a key with a third of all rows costs its task one row per Arrow batch.  State lives in RocksDB, versioned by batch: a
batch that is tried again starts from the state the batch before it left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
LEADS = -1
CELLS = 1 << 15                      # groups that the keys taken are kept in
MOST_LISTS = 64                      # entries of a cell's list before they become one

# Rows as text and back without loss.
_EXACT = {"mode": "FAILFAST", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
          "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "maxStringLen": str(2**31 - 1)}


def start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a stream of this module's processors.  A stream keeps the settings it starts with; the session gets its
    own back.  Without batches of no data, states past their time go with the next batch that has some; with
    them, a stream that reads what is there and ends would never end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _leading(newest: bool):
    """For each row of an Arrow batch ``LEADS`` if it comes first (last, if ``newest``) of its key, else its number in
    the batch.  Rows with a null key never lead."""
    def places(key: pa.Array, *order: pa.Array) -> pa.Array:
        number = np.arange(len(key), dtype=np.int32)
        names = [f"o{i}" for i in range(len(order))]
        table = pa.table([key, *order, pa.array(number)], names=["key", *names, "number"])
        way, nulls = ("descending", "at_end") if newest else ("ascending", "at_end")
        rank = pa.compute.sort_indices(table, sort_keys=[("key", "ascending"), *[(n, way) for n in names],
                                                         ("number", way)], null_placement=nulls)
        table = table.take(rank)
        first = table.group_by("key", use_threads=False).aggregate([("number", "first")])
        lead = first.filter(pa.compute.is_valid(first["key"]))["number_first"].to_numpy()
        number[lead] = LEADS
        return pa.array(number)
    return places


def leading(key: Column, order: list[Column], newest: bool = False) -> Column:
    return F.arrow_udf(_leading(newest), "int")(key, *order)


# --- Z2: submissions already taken --------------------------------------------------------------------
class FirstSubmission(StatefulProcessor):
    """Tells the first row of a key from its repeats, a cell of keys at a time; a key is forgotten ``days`` after it
    was taken.  A call of the state store costs far more than a key, so a cell's keys share its calls: what a batch
    takes is one entry of the cell's list, 40 bytes a key (digest, and until when it is known)."""

    ENTRY = np.dtype([("digest", "V32"), ("until", "<i8")])

    def __init__(self, days: float):
        self.ttl = int(days * DAY_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getListState("taken_keys", "entries binary", self.ttl)

    def _known(self, now: int) -> tuple[np.ndarray, int]:
        """The entries that still hold, and how many list entries they came from."""
        lists = [entries for (entries,) in self.taken.get()]
        known = np.frombuffer(b"".join(lists), self.ENTRY)
        return known[known["until"] > now], len(lists)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        marked, entries, lists, known, firsts = Row("row", "repeated"), None, 0, set(), {}
        for row, lead, _ in rows:
            if not lead:
                yield marked(row, lead is not None)
                continue
            if entries is None:
                entries, lists = self._known(now)
                known = set(entries["digest"].tolist())
            digest, order = lead[:32], lead[32:]
            first = firsts.get(digest)
            if digest in known:
                yield marked(row, True)
            elif first is None or order < first[0]:
                if first is not None:
                    yield marked(first[1], True)
                firsts[digest] = order, row
            else:
                yield marked(row, True)
        if firsts:
            new = np.zeros(len(firsts), self.ENTRY)
            new["digest"] = np.frombuffer(b"".join(firsts), "V32")
            new["until"] = now + self.ttl
            if lists < MOST_LISTS:
                self.taken.appendValue((new.tobytes(),))
            else:                                    # many small batches: their entries become one
                self.taken.put([(np.concatenate([entries, new]).tobytes(),)])
        for _, row in firsts.values():
            yield marked(row, False)

    def close(self) -> None:
        pass


def mark_repeats(stream: DataFrame, key: Column, at: str, nth: str, days: float, cells: int = CELLS) -> DataFrame:
    """The rows of a stream with ``repeated``: whether an earlier row (by the timestamp ``at``, then ``nth``) of the
    batch, or any row taken by a batch of the last ``days``, has the same key.  Rows with a null key are never
    repeats and keep no state.  No row is dropped.

    Keys are kept in ``cells`` groups, by hash.  A batch reads the cells of its own keys: a stream that keeps some
    hundred million keys or more in small batches wants more cells (fixed for the life of its checkpoint)."""
    names = stream.columns
    types = [T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType for f in stream.schema]
    zoned = [f.name for f in stream.schema if isinstance(f.dataType, T.TimestampType)]
    # A row travels as one string, its times as microseconds, and its key and order as one: Python takes it apart
    # value by value otherwise.
    packed = F.struct(*[(F.unix_micros(f"`{c}`") if c in zoned else F.col(f"`{c}`")).alias(f"c{i}")
                        for i, c in enumerate(names)])
    rows = stream.select(F.to_json(packed, _EXACT).alias("row"), key.cast("string").alias("key"),
                         F.coalesce(F.unix_micros(at), F.lit(0)).alias("at"),
                         F.coalesce(F.col(nth).cast("string"), F.lit("")).alias("nth"))
    rows = rows.withColumn("place", leading(F.col("key"), [F.col("at"), F.col("nth")]))
    leads = F.col("place") == LEADS
    at_bytes = F.unhex(F.lpad(F.hex(F.col("at").bitwiseXOR(F.lit(-1 << 63))), 16, "0"))        # in the order of ``at``
    lead = F.when(leads, F.concat(F.unhex(F.sha2("key", 256)), at_bytes, F.encode("nth", "UTF-8"))).when(
        F.col("key").isNotNull(), F.lit(b""))
    spread = F.xxhash64("nth", "place")                                 # rows that need no state go anywhere
    rows = rows.select("row", lead.alias("lead"),
                       F.pmod(F.when(leads, F.xxhash64("key")).otherwise(spread), F.lit(cells)).alias("cell"))
    out = T.StructType([T.StructField("row", T.StringType()), T.StructField("repeated", T.BooleanType())])
    marked = rows.groupBy("cell").transformWithState(FirstSubmission(days), out, "append", "ProcessingTime")
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    marked = marked.select(F.from_json("row", schema, _EXACT).alias("row"), "repeated")
    return marked.select(*[(F.timestamp_micros(F.col(f"row.c{i}")) if c in zoned else F.col(f"row.c{i}")).alias(c)
                           for i, c in enumerate(names)], "repeated")


# --- A1: counts that follow each change -----------------------------------------------------------------
class LatestGroup(StatefulProcessor):
    """Keeps the group of an application's newest row; a newer row takes one from its old group and adds one to its new one."""

    def __init__(self, group_type: T.StructType):
        self.group_type = group_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = self.group_type.names
        self.newest = handle.getValueState("newest", T.StructType([
            T.StructField("at", T.LongType()), T.StructField("event_id", T.LongType()), *self.group_type.fields]))

    @staticmethod
    def _age(at, event_id):
        return (at is not None, at or 0, event_id is not None, event_id or 0)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.newest.get() if self.newest.exists() else None
        new = max(rows, key=lambda r: self._age(r.at, r.event_id))
        if old is not None and self._age(old[0], old[1]) >= self._age(new.at, new.event_id):
            return
        group = tuple(new[n] for n in self.names)
        self.newest.update((new.at, new.event_id, *group))
        if old is None or tuple(old[2:]) != group:
            if old is not None:
                yield Row(**dict(zip(self.names, old[2:])), n=-1)
            yield Row(**dict(zip(self.names, group)), n=1)

    def close(self) -> None:
        pass


def count_changes(ledger_rows: DataFrame, *groups: str) -> DataFrame:
    """(groups, n): -1 and +1 for every application whose newest row moves to another group, +1 for a new one.
    ``groups`` are string columns; null is a group of its own, and all rows without an application are one."""
    rows = ledger_rows.select(F.coalesce(F.concat(F.lit("="), "application_id"), F.lit("")).alias("state_key"),
                              F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), "event_id",
                              *[F.col(g).cast("string").alias(g) for g in groups])
    rows = rows.where(leading(F.col("state_key"), [F.col("at"), F.col("event_id")], newest=True) == LEADS)
    group_type = T.StructType([T.StructField(g, T.StringType()) for g in groups])
    out = T.StructType([*group_type.fields, T.StructField("n", T.LongType())])
    return rows.groupBy("state_key").transformWithState(LatestGroup(group_type), out, "append", "None")
