"""Structured Streaming forms equal their batch forms (Z1-Z4) and the batch job writes the ledger."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from conftest import PERSONAS, SF01, write_payloads
from lendflow.operators import dashboard, ledger
from lendflow.plans import assess
from lendflow.sources import derived as D
from lendflow.streaming import stream


def test_batch_job_writes_ledger_and_rejects(spark, tmp_path):
    raw = write_payloads(tmp_path / "raw", PERSONAS + [dict(PERSONAS[0], application_id="APP-ZERO", gross_annual_income=0)])
    out = assess.run(spark, raw, str(tmp_path / "ledger"), str(tmp_path / "rejects"), dt.datetime(2024, 3, 1))
    led = ledger.read_ledger(spark, out["ledger_path"])
    rows = {r.application_id: r for r in led.collect()}
    assert set(rows) == {"APP-101", "APP-102", "APP-103", "APP-104"}
    assert rows["APP-101"].underwriter_decision == "AUTO_APPROVED"
    assert rows["APP-103"].policy_breaches.startswith("Living Expense Discrepancy: Declared $1600 vs Actual $3450; ")
    assert len({r.event_id for r in rows.values()}) == 4
    rej = spark.read.parquet(out["rejects_path"]).collect()
    assert [r.application_id for r in rej] == ["APP-ZERO"]
    # the same run again leaves nothing twice
    assess.run(spark, raw, out["ledger_path"], out["rejects_path"], dt.datetime(2024, 3, 1))
    assert ledger.read_ledger(spark, out["ledger_path"]).count() == 4
    assert spark.read.parquet(out["rejects_path"]).count() == 1
    # a second run appends (ledger is append-only) with fresh event ids
    assess.run(spark, raw, out["ledger_path"], out["rejects_path"], dt.datetime(2024, 3, 2))
    led = ledger.read_ledger(spark, out["ledger_path"])
    assert led.count() == 8 and led.select("event_id").distinct().count() == 8
    assert {r.timestamp for r in ledger.latest(led).collect()} == {dt.datetime(2024, 3, 2)}


def test_stream_assessment_equals_batch(spark, tmp_path):
    raw = write_payloads(tmp_path / "raw", PERSONAS)
    # a duplicate submission of APP-102 within the watermark is dropped
    with open(os.path.join(raw, "APP-102-again.json"), "w") as f:
        json.dump(PERSONAS[1], f, indent=4)
    q = stream.assess_stream(spark, raw, str(tmp_path / "sled"), str(tmp_path / "srej"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    s = stream.read_stream_ledger(spark, str(tmp_path / "sled"))
    cols = ["application_id", "system_recommendation", "calculated_dti", "net_monthly_surplus", "policy_breaches",
            "underwriter_decision"]
    b = assess.run(spark, write_payloads(tmp_path / "raw2", PERSONAS), str(tmp_path / "bled"), str(tmp_path / "brej"))
    bl = ledger.read_ledger(spark, b["ledger_path"])
    assert sorted(map(tuple, s.select(*cols).collect())) == sorted(map(tuple, bl.select(*cols).collect()))
    # restarting the query on the same checkpoint processes nothing new and duplicates nothing
    q = stream.assess_stream(spark, raw, str(tmp_path / "sled"), str(tmp_path / "srej"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert stream.read_stream_ledger(spark, str(tmp_path / "sled")).count() == 4


def test_windowed_counts_and_latest_state_stream(spark, tmp_path):
    led_dir = str(tmp_path / "ledger_in")
    batch = D.ledger(spark, SF01)
    batch.write.parquet(led_dir)
    sdf = stream.windowed_decisions(stream.ledger_stream(spark, led_dir))
    q = (sdf.writeStream.outputMode("complete").format("memory").queryName("z3_counts")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("SELECT * FROM z3_counts").collect()))
    want = sorted(map(tuple, dashboard.decisions_per_window(batch).collect()))
    assert got == want
    q = stream.latest_state_stream(spark, led_dir, str(tmp_path / "state"), str(tmp_path / "ckpt4"))
    q.awaitTermination(120)
    # a second batch of events arrives: only the applications it touches are emitted
    more = batch.filter(F.col("application_id").isin("APP-1", "APP-2")).withColumns(
        {"event_id": F.col("event_id") + 10**6, "timestamp": F.col("timestamp") + F.expr("INTERVAL 60 DAYS"),
         "underwriter_decision": F.lit("DECLINED")})
    more.write.mode("append").parquet(led_dir)
    q = stream.latest_state_stream(spark, led_dir, str(tmp_path / "state"), str(tmp_path / "ckpt4"))
    q.awaitTermination(120)
    changes = spark.read.parquet(str(tmp_path / "state"))
    assert changes.filter("batch = 1").select("application_id").distinct().count() == 2
    st = stream.read_state(spark, str(tmp_path / "state"))
    full = batch.unionByName(more)
    cols = batch.columns
    assert sorted(map(tuple, st.select(*cols).collect())) == sorted(map(tuple, ledger.latest(full).select(*cols).collect()))


def test_assessment_with_index_and_completions(spark, tmp_path):
    from conftest import PERSONAS
    from lendflow import params as P
    from lendflow.operators import retrieval
    from lendflow.sources.payloads import read_applications
    regs = tmp_path / "regs"
    regs.mkdir()
    (regs / "apg.txt").write_text("Serviceability is assessed at a buffer above the loan rate. Net surplus must be positive.")
    (regs / "rg.txt").write_text("Living expenses must be verified against the HEM benchmark and declared expenses.")
    index = retrieval.open_or_build_index(spark, retrieval.read_corpus_dir(spark, str(regs)), str(tmp_path / "idx"))
    comps = spark.createDataFrame([("APP-102", None, "  Memo for 102. ", None), ("APP-103", None, None, "boom")],
                                  "application_id string, blocks array<struct<text:string>>, plain string, error string")
    raw = write_payloads(tmp_path / "raw", PERSONAS)
    with open(os.path.join(raw, "APP-103-again.json"), "w") as f:    # duplicate submission
        json.dump(PERSONAS[2], f, indent=4)
    apps = read_applications(spark, raw)
    out, rejected = assess.assess_applications(apps, index=index, completions=comps)
    collected = out.collect()
    assert sorted(r.application_id for r in collected) == ["APP-101", "APP-102", "APP-103", "APP-103", "APP-104"]
    rows = {r.application_id: r for r in collected}
    assert rejected.count() == 0
    assert rows["APP-101"].regulatory_citations is None                      # clean: no retrieval
    assert rows["APP-101"].ai_risk_memo.startswith("Application APP-101 meets all")
    assert rows["APP-103"].regulatory_citations.startswith("[Citation 1 - ")
    assert rows["APP-103"].regulatory_citations.count("[Citation ") == 2     # k = 2
    assert rows["APP-102"].ai_risk_memo == "Memo for 102."
    assert rows["APP-103"].ai_risk_memo == P.MEMO_FALLBACK                   # failed call
    assert rows["APP-104"].ai_risk_memo == P.MEMO_FALLBACK                   # no completion


def test_stream_without_dedupe_keeps_each_submission_once(spark, tmp_path):
    raw = write_payloads(tmp_path / "raw", PERSONAS[:2])
    with open(os.path.join(raw, "APP-102-again.json"), "w") as f:
        json.dump(PERSONAS[1], f, indent=4)
    q = stream.assess_stream(spark, raw, str(tmp_path / "sled"), str(tmp_path / "srej"), str(tmp_path / "ckpt"),
                             dedupe=False)
    q.awaitTermination(120)
    s = stream.read_stream_ledger(spark, str(tmp_path / "sled"))
    assert sorted(r.application_id for r in s.collect()) == ["APP-101", "APP-102", "APP-102"]


def test_every_payload_is_accounted_for(spark, tmp_path):
    """Default arguments: three malformed files, a repeat, a changed resubmission, and later an old file."""
    raw = tmp_path / "raw"
    write_payloads(raw, PERSONAS)
    for i in range(3):
        (raw / f"BROKEN-{i}.json").write_text('{ "application_id": "APP-90%d", ' % i)
    (raw / "APP-102-again.json").write_text(json.dumps(PERSONAS[1]))
    (raw / "APP-103-changed.json").write_text(json.dumps(dict(PERSONAS[2], requested_loan_amount=1)))
    where = [str(tmp_path / x) for x in ("led", "rej", "ckpt")]
    stream.assess_stream(spark, str(raw), *where).awaitTermination(120)
    old = raw / "APP-OLD.json"
    old.write_text(json.dumps(dict(PERSONAS[0], application_id="APP-OLD")))
    os.utime(old, (1_600_000_000, 1_600_000_000))          # years before everything else
    (raw / "APP-104-late-repeat.json").write_text(json.dumps(PERSONAS[3]))
    stream.assess_stream(spark, str(raw), *where).awaitTermination(120)
    led = stream.read_stream_ledger(spark, where[0]).collect()
    assert sorted(r.application_id for r in led) == ["APP-101", "APP-102", "APP-103", "APP-103", "APP-104", "APP-OLD"]
    assert len({r.event_id for r in led}) == 6
    rej = spark.read.option("mergeSchema", True).parquet(where[1]).collect()
    assert sorted(r.reject_reasons[0] for r in rej) == ["duplicate_submission"] * 2 + ["malformed_json"] * 3
    assert all(r._corrupt_record for r in rej if r.reject_reasons[0] == "malformed_json")
    assert len(led) + len(rej) == len(list(raw.glob("*.json")))


def test_stream_layout_compacts(spark, tmp_path):
    raw = tmp_path / "raw"
    where = [str(tmp_path / x) for x in ("led", "rej", "ckpt")]
    for i in range(3):
        write_payloads(raw, [dict(PERSONAS[0], application_id=f"APP-{i}{k}") for k in range(3)])
        stream.assess_stream(spark, str(raw), *where).awaitTermination(120)
    rows = sorted(map(tuple, stream.read_stream_ledger(spark, where[0]).collect()))
    day = rows[0][-1]
    ledger.compact(spark, where[0], day, before=2, files=2)      # the newest batch may still be written to
    assert sorted(map(tuple, stream.read_stream_ledger(spark, where[0]).collect())) == rows
    assert not list((tmp_path / "led" / "batch=0").glob("dt=*")) and list((tmp_path / "led" / "batch=2").glob("dt=*"))


def test_state_folds(spark, tmp_path):
    led_dir, root = str(tmp_path / "in"), str(tmp_path / "state")
    batch = D.ledger(spark, SF01)
    for i in range(3):
        batch.filter(F.col("event_id") % 3 == i).write.mode("append").parquet(led_dir)
        stream.latest_state_stream(spark, led_dir, root, str(tmp_path / "ckpt")).awaitTermination(120)
    want = sorted(map(tuple, ledger.latest(batch).collect()))
    for before in (2, 3):
        stream.fold_state(spark, root, before)
        got = stream.read_state(spark, root).select(*batch.columns)
        assert sorted(map(tuple, got.collect())) == want
    assert stream.read_state(spark, str(tmp_path / "none")) is None
