"""Ledger, decisions and console queries on literal unit rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lendflow.operators import dashboard, decisions, ledger
from lendflow.sources.schemas import DECISION_SCHEMA, LEDGER_SCHEMA

T0 = dt.datetime(2024, 1, 1, 9, 0, 0)


def _row(eid, app, rec, dec, ts, uid="SYS", notes="N/A", etype="SYSTEM"):
    return (eid, etype, app, "<PERSON>", rec, 1.0, 2.0, "NONE", uid, dec, notes, ts, ts.date())


def _ledger(spark):
    rows = [
        _row(1, "A", "ESCALATED_REFERRAL", "PENDING_REVIEW", T0),
        _row(2, "A", "ESCALATED_REFERRAL", "APPROVED_OVERRIDE", T0 + dt.timedelta(hours=1), "uw_1", "it's fine now", "HUMAN"),
        _row(3, "A", "ESCALATED_REFERRAL", "PENDING_REVIEW", T0 + dt.timedelta(hours=2)),  # re-run hides decision
        _row(4, "B", "AUTO_APPROVE", "AUTO_APPROVED", T0),
        _row(5, "C", "ESCALATED_REFERRAL", "PENDING_REVIEW", T0),
        _row(6, "C", "ESCALATED_REFERRAL", "DECLINED", T0, "uw_2", "tied timestamp", "HUMAN"),  # tie: id breaks it
        _row(7, "D", None, "PENDING_REVIEW", T0),                                   # null recommendation
        _row(8, "E", "ESCALATED_REFERRAL", None, T0),                               # null decision
    ]
    return spark.createDataFrame(rows, LEDGER_SCHEMA)


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_latest_window_equals_aggregate(spark):
    led = _ledger(spark)
    cols = led.columns
    assert _rows(ledger.latest(led), cols) == _rows(ledger.latest_agg(led), cols)
    latest = {r.application_id: r.event_id for r in ledger.latest(led).collect()}
    assert latest == {"A": 3, "B": 4, "C": 6, "D": 7, "E": 8}


def test_point_and_newest(spark):
    led = _ledger(spark)
    assert ledger.point(led, "A").first().event_id == 3
    assert ledger.point(led, "Z").collect() == []
    assert ledger.newest_overall(led).first().event_id == 3


def test_hidden_decisions(spark):
    led = _ledger(spark)
    cols = ["application_id", "event_id", "latest_decision", "hidden_decision"]
    a = _rows(ledger.hidden_decisions(led), cols)
    assert a == [("A", 3, "PENDING_REVIEW", "APPROVED_OVERRIDE")]


def test_dashboard_counts_and_queues(spark):
    lat = ledger.latest(_ledger(spark))
    c = dashboard.counts(lat).first()
    assert (c.total, c.pending, c.approved, c.declined) == (5, 2, 1, 1)
    assert {r.application_id for r in dashboard.queue(lat, "PENDING").collect()} == {"A", "D"}
    assert {r.application_id for r in dashboard.queue(lat, "APPROVED").collect()} == {"B"}
    assert {r.application_id for r in dashboard.queue(lat, "DECLINED").collect()} == {"C"}
    assert dashboard.queue(lat, "ALL").count() == 5


def _decisions(spark):
    rows = [
        (10, "A", "DECLINED", "  short  ", "alice", T0 + dt.timedelta(hours=3)),             # 5 chars stripped
        (11, "A", "APPROVED_OVERRIDE", " 0123456789 ", "bob", T0 + dt.timedelta(hours=4)),   # exactly 10
        (12, "A", "DECLINED", "a later decision", "carol", T0 + dt.timedelta(hours=5)),      # already decided
        (13, "B", "DECLINED", "not pending at all", "dave", T0 + dt.timedelta(hours=5)),      # not pending
        (14, "D", "DECLINED", "notes with a ' quote", "erin", T0 + dt.timedelta(hours=5)),
        (15, "D", "APPROVED_OVERRIDE", "012345678", "frank", T0 + dt.timedelta(hours=6)),    # 9 chars
    ]
    df = spark.createDataFrame([(r[0],) + r[1:] for r in rows],
                               "decision_id long, application_id string, decision string, notes string, "
                               "underwriter_id string, event_ts timestamp_ntz")
    return df


def test_validation_and_gate(spark):
    d = _decisions(spark)
    v = {r.decision_id: (r.action, r.clean_notes, r.notes_valid) for r in decisions.validate(d).collect()}
    assert v[10] == ("DECLINE", "short", False)
    assert v[11] == ("APPROVE", "0123456789", True)
    assert v[15][2] is False
    passed, rejected = decisions.gate(d, _ledger(spark))
    assert sorted(r.decision_id for r in passed.collect()) == [11, 12, 14]
    rej = {r.decision_id: r.reject_reason for r in rejected.collect()}
    assert rej == {10: "notes_too_short", 15: "notes_too_short", 13: "not_pending"}
    acc = {r.application_id: r.decision_id for r in decisions.accepted(d, _ledger(spark)).collect()}
    assert acc == {"A": 11, "D": 14}   # the earliest valid decision lands


def test_update_forms_agree(spark):
    led, d = _ledger(spark), _decisions(spark)
    acc = decisions.accepted(d, led)
    upd = ledger.update_in_place(led, acc)
    a_rows = {r.event_id: r for r in upd.collect()}
    assert a_rows[1].underwriter_decision == "APPROVED_OVERRIDE" and a_rows[1].underwriter_id == "bob"
    assert a_rows[7].underwriter_notes == "notes with a ' quote"
    assert a_rows[4].underwriter_decision == "AUTO_APPROVED"          # untouched
    assert a_rows[1].timestamp == T0                                    # timestamps unchanged
    ev = ledger.decision_events(led, acc, base_event_id=1000)
    state_cols = ["application_id", "system_recommendation", "underwriter_id", "underwriter_decision",
                  "underwriter_notes"]
    assert _rows(ledger.latest_agg(upd), state_cols) == _rows(ledger.latest_agg(led.unionByName(ev)), state_cols)


def test_reset_forms_agree(spark):
    led = _ledger(spark)
    r = {x.event_id: x for x in ledger.reset_in_place(led).collect()}
    assert r[2].underwriter_decision == "PENDING_REVIEW" and r[2].underwriter_notes == "N/A"
    assert r[4].underwriter_decision == "AUTO_APPROVED"     # AUTO_APPROVE rows stay
    assert r[7].underwriter_decision == "PENDING_REVIEW" and r[7].underwriter_id == "SYS"  # null rec untouched
    ev = ledger.reset_events(led, T0 + dt.timedelta(days=1), base_event_id=1000)
    cols = ["application_id", "underwriter_id", "underwriter_decision", "underwriter_notes"]
    assert _rows(ledger.latest_agg(ledger.reset_in_place(led)), cols) == _rows(
        ledger.latest_agg(led.unionByName(ev)), cols)


def test_append_and_reopen(spark, tmp_path):
    path = str(tmp_path / "ledger")
    empty = ledger.ensure_ledger(spark, path)
    assert empty.count() == 0
    ledger.append(_ledger(spark), path, 1)
    ledger.append(_ledger(spark).filter(F.col("application_id") == "A"), path, 2)   # append-only
    ledger.append(_ledger(spark).filter(F.col("application_id") == "A"), path, 2)   # a retry of run 2
    led = ledger.read_ledger(spark, path)
    assert led.count() == 11 and led.select("event_id").distinct().count() == 11


def test_event_ids_are_unique_over_many_partitions_and_batches(spark):
    rows = spark.range(0, 1000, 1, 200).withColumn("x", F.col("id"))
    ids = []
    for batch in (0, 1):
        out = ledger.numbered(rows.drop("id"), ledger.run_base(batch)).collect()
        got = sorted(r.event_id for r in out)
        assert got == list(range(batch << 32, (batch << 32) + 1000)) and {r.x for r in out} == set(range(1000))
        ids += got
    assert len(set(ids)) == 2000


def test_only_absence_means_a_new_ledger(spark, tmp_path):
    broken = tmp_path / "broken" / "batch=0" / "dt=2024-01-01"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        ledger.ensure_ledger(spark, str(tmp_path / "broken")).collect()


def test_decision_schema_has_no_sql_text():
    assert [f.name for f in DECISION_SCHEMA.fields] == ["application_id", "decision", "notes", "underwriter_id", "event_ts"]


def test_ledger_as_sql_table(spark, tmp_path):
    path = str(tmp_path / "sql_ledger")
    ledger.append(_ledger(spark).coalesce(1).orderBy("event_id"), path, 1)
    ledger.create_table(spark, path, "audit_trail_t")
    ledger.create_table(spark, path, "audit_trail_t")            # IF NOT EXISTS: idempotent
    top = spark.sql("SELECT application_id, system_recommendation, underwriter_decision FROM audit_trail_t "
                    "ORDER BY timestamp DESC, event_id DESC LIMIT 1").first()
    assert top.application_id == "A" and top.underwriter_decision == "PENDING_REVIEW"
    assert spark.sql("SELECT count(*) FROM audit_trail_t WHERE dt = DATE'2024-01-01'").first()[0] == 8
    spark.sql("DROP TABLE audit_trail_t")


def test_compact_one_day(spark, tmp_path):
    path = tmp_path / "ledger_c"
    for i in range(4):                                             # four small appends
        ledger.append(_ledger(spark).repartition(3), str(path), i)
    before = sorted(map(tuple, ledger.read_ledger(spark, str(path)).collect()), key=repr)

    def files():
        return {i: len(list(path.glob(f"batch={i}/dt=2024-01-01/*.parquet"))) for i in range(4)}
    was = files()
    ledger.compact(spark, str(path), T0.date(), before=3, files=2)
    assert files() == {0: 0, 1: 0, 2: 2, 3: was[3]}                # the newest run is left alone
    ledger.compact(spark, str(path), T0.date(), before=3, files=2)
    assert sorted(map(tuple, ledger.read_ledger(spark, str(path)).collect()), key=repr) == before
