"""The assessment job: payloads -> quarantine -> mask -> metrics -> policy -> (breached:
retrieval + completions) -> ledger rows.

The reference runs one application per invocation through a stage graph; here all applications
of a batch go through one DataFrame plan.  Stages up to the policy gate are a single narrow stage
(no shuffle); the only exchanges are the k-NN join over *distinct* breach texts, the completion
join and the write.  Clean and breached applications are not split into two scans: the outcome
columns are ``when`` expressions on one DataFrame (U1).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendflow import params as P
from lendflow.operators import ledger, memo, policy, privacy, retrieval
from lendflow.sources.payloads import quarantine, read_applications, with_notes_default


def assess_applications(apps: DataFrame, p=P.DEFAULT_POLICY, index=None, completions: DataFrame | None = None,
                        k: int = P.RETRIEVAL_K, directory: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcome, rejected).

    ``index``: optional (chunks, index) from ``retrieval.open_or_build_index``; breached rows then
    get ``regulatory_citations``.  ``completions``: optional
    completion table; breached rows then get ``ai_risk_memo`` (fallback text on failure).
    ``directory``: optional names (``real_name``); notes then lose all of them, not the applicant's alone."""
    valid, rejected = quarantine(apps, p)
    out = policy.with_outcome(policy.assess(privacy.mask_applications(with_notes_default(valid), directory), p))
    breached = ~policy.is_clean()
    # Both attachments keep one output row per input row: citations join on the (distinct)
    # query text, null for clean files; completions join on the id (one completion per call).
    if index is not None:
        chunks, found = index
        out = out.withColumn("query_text", F.when(breached, retrieval.query_text()))
        out = retrieval.retrieve_for_texts(out, chunks, found, k=k).drop("query_text")
    if completions is not None:
        out = memo.attach_completions(out, completions, out="_memo")
        out = out.withColumns({
            "ai_risk_memo": F.coalesce("ai_risk_memo", F.when(breached, F.col("_memo"))),
            "completion_failed": F.when(breached, F.col("completion_failed")),
        }).drop("_memo")
    return out, rejected


def run(spark: SparkSession, payload_dir: str, ledger_path: str, rejects_path: str,
        run_ts: dt.datetime | None = None, p=P.DEFAULT_POLICY, index=None, completions=None,
        run_id: int | None = None, directory: DataFrame | None = None) -> dict:
    """Assess every payload in ``payload_dir`` as one run: its ledger rows go to
    ``<ledger>/batch=<run_id>`` and its quarantined rows to ``<rejects>/batch=<run_id>``.

    Both writes overwrite that run's own folders, so a run that died is repeated with its
    ``run_id`` (default: the run's second) and leaves nothing twice.  The payload read is persisted once
    because both halves of the quarantine split consume it."""
    run_ts = run_ts or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if run_id is None:
        run_id = int((run_ts - dt.datetime(1970, 1, 1)).total_seconds())
    apps = read_applications(spark, payload_dir).persist()
    try:
        out, rejected = assess_applications(apps, p, index, completions, directory=directory)
        ledger.ensure_ledger(spark, ledger_path)
        ledger.append(ledger.audit_rows(out, run_ts), ledger_path, run_id)
        (rejected.withColumn("rejected_at", ledger.wall_clock(run_ts))
         .write.mode("overwrite").parquet(f"{rejects_path.rstrip('/')}/batch={run_id}"))
        return {"ledger_path": ledger_path, "rejects_path": rejects_path, "run_ts": run_ts.isoformat(), "run_id": run_id}
    finally:
        apps.unpersist()


def main(argv=None) -> None:
    """``python -m lendflow.plans.assess PAYLOADS LEDGER REJECTS [--corpus DIR --index DIR]
    [--completions PARQUET] [--directory PARQUET]``: assess every payload and append to the ledger."""
    import argparse
    import json

    from lendflow.session import build_session, checkpoint_dir
    ap = argparse.ArgumentParser(prog="lendflow.plans.assess")
    ap.add_argument("payloads")
    ap.add_argument("ledger")
    ap.add_argument("rejects")
    ap.add_argument("--corpus", help="folder of regulation text exports (pages split by form feeds)")
    ap.add_argument("--index", help="folder of the persisted retrieval index (built if absent)")
    ap.add_argument("--completions", help="parquet table of model completions per application")
    ap.add_argument("--directory", help="parquet table of names (real_name) that notes must not hold")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    spark = build_session(a.master)
    checkpoint_dir(spark)
    index = None
    if a.index:
        corpus = retrieval.read_corpus_dir(spark, a.corpus) if a.corpus else None
        index = retrieval.open_or_build_index(spark, corpus, a.index)
    comps = spark.read.parquet(a.completions) if a.completions else None
    names = spark.read.parquet(a.directory) if a.directory else None
    print(json.dumps(run(spark, a.payloads, a.ledger, a.rejects, index=index, completions=comps, directory=names)))


if __name__ == "__main__":
    main()
