"""Keyed state of the streams: repeats (Z2) and live counts (A1) against their batch forms, batch by batch."""

import datetime as dt
import time
from decimal import Decimal as D
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from lendflow.operators import dashboard, ledger
from lendflow.sources.schemas import LEDGER_SCHEMA
from lendflow.streaming import state, stream

T0 = dt.datetime(2024, 5, 1)


def test_leading_rows_of_an_arrow_batch():
    key, at, nth = pa.array(["a", "b", "a", None, "a", "b"]), pa.array([2, 5, 1, 0, 1, None]), pa.array(list("zyxwvu"))
    assert state._leading(False)(key, at, nth).to_pylist() == [0, -1, 2, 3, -1, 5]
    assert state._leading(True)(key, at, nth).to_pylist() == [-1, -1, 2, 3, 4, 5]
    assert state._leading(False)(key[:0], at[:0], nth[:0]).to_pylist() == []


def test_repeats_over_batches(spark, tmp_path):
    """A key with most of the rows, repeats in one and over two batches, ties, null keys, a key that is forgotten."""
    src, root, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    schema = "k string, at timestamp, nth string, `a.b` decimal(9,2)"

    def run(rows, days):
        spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), n, None) for k, s, n in rows], schema).write.mode("append").parquet(src)
        marked = state.mark_repeats(spark.readStream.schema(schema).parquet(src), F.col("k"), "at", "nth", days)
        assert marked.columns == ["k", "at", "nth", "a.b", "repeated"]

        def write(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        state.start(marked.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True),
                    spark).awaitTermination(100)
        out = spark.read.parquet(root)
        return [tuple(r) for r in out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
                .select("k", "at", "nth", "repeated").collect()]

    hot = [("hot", 100 + i, f"{i:04d}") for i in range(3000)]
    first = run([*hot, ("hot", 99, "z"), ("tie", 5, "b"), ("tie", 5, "a"), (None, 1, "x"), (None, 1, "x"), ("once", 1, "x")], 30)
    assert len(first) == 3006
    taken = sorted((k, n) for k, _, n, again in first if k and not again)
    assert taken == [("hot", "z"), ("once", "x"), ("tie", "a")]
    assert [again for k, *_, again in first if k is None] == [False, False]
    assert {at for k, at, n, _ in first if n == "z"} == {T0 + dt.timedelta(seconds=99)}
    second = run([("hot", 1, "y"), ("new", 1, "y"), ("new", 2, "y"), (None, 1, "x")], 30)
    assert sorted((k or "", n, again) for k, _, n, again in second) == [
        ("", "x", False), ("hot", "y", True), ("new", "y", False), ("new", "y", True)]


def test_a_key_is_forgotten(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    seen = []
    for _ in range(2):
        spark.createDataFrame([("k", T0, "n")], "k string, at timestamp, nth string").write.mode("append").parquet(src)
        marked = state.mark_repeats(spark.readStream.schema("k string, at timestamp, nth string").parquet(src),
                                    F.col("k"), "at", "nth", 1 / state.DAY_MS)
        state.start(marked.writeStream.foreachBatch(lambda b, i: seen.append(b.collect()[0].repeated))
                    .option("checkpointLocation", ckpt).trigger(availableNow=True), spark).awaitTermination(100)
        time.sleep(0.1)
    assert seen == [False, False]


class _Cell:
    """One cell's list as a handle and a state of it; counts the calls."""

    def __init__(self):
        self.entries, self.calls = [], 0

    def getListState(self, name, schema, ttl):
        return self

    def get(self):
        self.calls += 1
        return iter(list(self.entries))

    def appendValue(self, value):
        self.calls += 1
        self.entries.append(value)

    def put(self, values):
        self.calls += 1
        self.entries = list(values)


def test_keys_of_a_cell_share_the_calls_of_the_state_store():
    cell, days = _Cell(), 1000 / state.DAY_MS
    first = state.FirstSubmission(days)
    first.init(cell)
    rows = Row("row", "lead", "cell")

    def batch(now, *marks):
        leads = [rows(f"{k}/{order}", bytes([k]) + bytes(31) + order.encode(), 0) for k, order in marks]
        clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
        return sorted(r.row for r in first.handleInputRows((0,), iter(leads), clock) if not r.repeated)

    assert batch(0, *[(k, o) for k in range(200) for o in "ba"]) == sorted(f"{k}/a" for k in range(200))
    assert cell.calls == 2                                           # one read, one write: not some for every key
    for i in range(2 * state.MOST_LISTS):                            # many small batches: the list stays short
        assert batch(1 + i, (200, "x"), (3, "x"), (100, "y")) == (["200/x"] if i == 0 else [])
        assert batch(1 + i, (201 + i % 50, "x")) == ([f"{201 + i}/x"] if i < 50 else [])
    for i in range(2 * state.MOST_LISTS):
        batch(2000 * (i + 1), (i, "z"))
    assert len(cell.entries) <= state.MOST_LISTS
    assert all(len(e) // 40 <= 2 for (e,) in cell.entries[1:])
    now = 4000 * state.MOST_LISTS
    assert batch(now + 999, (127, "q"), (1, "q")) == ["1/q"] and batch(now + 1000, (127, "q"), (1, "q")) == ["127/q"]


def test_rows_keep_their_values(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = ("k string, at timestamp, n timestamp_ntz, d decimal(18,2), r decimal(9,6), x double, big bigint, b boolean, "
              "day date, raw binary, list array<string>, `_corrupt_record` string, `_CORRUPT_record2` string")
    late = T0 + dt.timedelta(microseconds=123456)
    rows = [("a", late, late, D("9999999999999999.99"), D("0.063500"), 0.1, 2**63 - 1, True, T0.date(), b"\x00\xff",
             ["x", None, ""], '{ "a": "\\u00e9\n\u2028 \u20ac" ', ""),
            ("a", None, None, None, None, float("inf"), None, None, None, None, None, None, None),
            (None, T0, T0, D("-0.10"), D("-0.030000"), -0.0, -2**63, False, T0.date(), b"", [], "\t\x00", "null")]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(src)
    marked = state.mark_repeats(spark.readStream.schema(schema).parquet(src), F.col("k"), "at", "d", 30, cells=1)
    assert [(f.name, f.dataType) for f in marked.schema][:-1] == [(f.name, f.dataType) for f in df.schema]
    state.start(marked.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out)).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True), spark).awaitTermination(100)
    got = spark.read.parquet(out)
    assert sorted(map(str, got.drop("repeated").collect())) == sorted(map(str, df.collect()))
    assert sorted(str((r.k, r.at is None, r.repeated)) for r in got.collect()) == [
        "('a', False, True)", "('a', True, False)", "(None, False, False)"]


def _event(i, app, day, decision, recommendation="R"):
    ts = None if day is None else T0 + dt.timedelta(days=day)
    return (i, "SYSTEM", app, "p", recommendation, 1.0, 1.0, "NONE", "u", decision, "n", ts, None)


def test_live_counts_follow_every_batch(spark, tmp_path):
    src, root, ckpt = (str(tmp_path / x) for x in ("src", "counts", "ckpt"))
    rounds = [
        [_event(i, "APP-HOT", i % 50, "PENDING_REVIEW") for i in range(3000)] + [
            _event(9001, "APP-1", 1, "PENDING_REVIEW"), _event(9002, "APP-1", 1, "DECLINED"),        # a tie by id
            _event(9003, "APP-2", None, "DECLINED"), _event(9004, None, 1, "AUTO_APPROVED")],
        [_event(9010, "APP-HOT", 90, "APPROVED_OVERRIDE"), _event(9011, "APP-1", 0, "AUTO_APPROVED"),   # late: older
         _event(9012, "APP-2", 0, None), _event(9013, "APP-3", 0, "INFO_REQUESTED", "S"), _event(9014, None, 2, "DECLINED")],
    ]
    for rows in rounds:
        spark.createDataFrame(rows, LEDGER_SCHEMA).write.mode("append").parquet(src)
        stream.live_counts_stream(spark, src, root, ckpt).awaitTermination(100)
        newest = ledger.latest_agg(spark.read.schema(LEDGER_SCHEMA).parquet(src))
        live = stream.read_counts(spark, root)
        assert dashboard.counts_of(live).collect() == dashboard.counts(newest).collect()
        want = newest.groupBy(*stream.COUNT_GROUPS).agg(F.count(F.lit(1)).alias("n"))
        assert sorted(map(str, live.collect())) == sorted(map(str, want.collect()))
    assert spark.read.parquet(root).where("batch = 1").count() <= 6
    assert dashboard.counts_of(live.limit(0)).first().asDict() == dict(total=0, pending=0, approved=0, declined=0)
