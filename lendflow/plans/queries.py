"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator family.

Every query reads the driver tables (or views Spark derives from them) whole; output columns are
aliased to the same names as the DuckDB oracle in ``lendflow.plans.oracle``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendflow import params as P
from lendflow.functions.metrics import amortised_repayment, flat_metrics, register_sql_functions, with_metrics
from lendflow.functions.text import mask_pii
from lendflow.operators import (chunking, dashboard, decisions, guard, inverted, ledger, memo, people, policy, portfolio,
                                privacy, retrieval)
from lendflow.operators.knn import knn
from lendflow.operators.lexical import lexical_groups, lexical_topk
from lendflow.operators.lsh import lsh_knn
from lendflow.operators.pivots import pivot_knn
from lendflow.session import checkpoint_dir, materialize, numbered
from lendflow.sources import derived as D
from lendflow.sources.payloads import quarantine as split_quarantine, split_duplicates, with_notes_default
from lendflow.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# The run timestamp stamped on audit rows in the registered (checkable) queries,
# and the application used for the point lookup.
RUN_TS = dt.datetime(2024, 2, 1, 0, 0, 0)
POINT_ID = "APP-42"
LEDGER_OUT = ("event_id", "event_type") + tuple(c for c in ledger.LEDGER_VIEW_COLUMNS if c != "event_id")
STATE_OUT = ("application_id", "system_recommendation", "calculated_dti", "net_monthly_surplus",
             "policy_breaches", "underwriter_id", "underwriter_decision", "underwriter_notes")


PROMPT_COLUMNS = ("applicant_name", "calculated_dti", "net_monthly_surplus", "system_recommendation", "policy_breaches",
                  "underwriter_decision")


MEMO_COLUMNS = ("application_id", "applicant_name", "gross_annual_income", "requested_loan_amount", "applicant_narrative_summary",
                "dti_result", "serviceability_result", "policy_breaches")


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def assessed(spark, sf_dir, p=P.DEFAULT_POLICY) -> DataFrame:
    """Applications -> masked -> metrics -> policy (one narrow stage after the derivation)."""
    return policy.assess(privacy.mask_applications(D.applications(spark, sf_dir)), p)


# --- deterministic core --------------------------------------------------------------------------
@query("app_metrics")
def app_metrics(spark, sf_dir):
    """The three metrics per application."""
    m = flat_metrics(with_metrics(D.applications(spark, sf_dir)))
    # Expense amounts are computed in decimal(18,2); the output is double so both engines' clients
    # render the values alike (decimal -> double is correctly rounded in both).
    return m.select("application_id", "calculated_dti", "dti_status",
                    F.col("applicable_monthly_expense").cast("double").alias("applicable_monthly_expense"),
                    F.col("expense_discrepancy").cast("double").alias("expense_discrepancy"),
                    "expense_status", "stressed_interest_rate",
                    "stressed_monthly_repayment", "net_monthly_surplus", "serviceability_status")


@query("breach_messages")
def breach_messages(spark, sf_dir):
    """P5 (a-c): ordered breach messages and codes per application."""
    a = assessed(spark, sf_dir)
    return a.select("application_id", F.size("breach_codes").alias("n_breaches"),
                    F.array_join("breach_codes", ",").alias("breach_codes"),
                    F.array_join("policy_breaches", "\n").alias("policy_breaches"))


@query("recommendation_counts")
def recommendation_counts(spark, sf_dir):
    """P6 + P7: applications per recommendation and breach-code combination (flagship)."""
    a = assessed(spark, sf_dir)
    return (a.groupBy("system_recommendation", F.array_join("breach_codes", ",").alias("breach_key"))
            .agg(F.count(F.lit(1)).alias("n_applications")))


@query("auto_approve_rows")
def auto_approve_rows(spark, sf_dir):
    """P7 + P8: the clean branch with its fixed memo and system decision."""
    clean, _ = policy.route(assessed(spark, sf_dir))
    return policy.auto_approve(clean).select(
        "application_id", "ai_risk_memo", "underwriter_id", "underwriter_decision", "underwriter_notes")


@query("audit_rows")
def audit_rows(spark, sf_dir):
    """K2 + A3 + U1: the ledger rows one run appends (branches re-joined without a split)."""
    rows = ledger.audit_rows(policy.with_outcome(assessed(spark, sf_dir)), RUN_TS)
    return rows.select(*ledger.LEDGER_VIEW_COLUMNS[1:])


@query("repayment_grid")
def repayment_grid(spark, sf_dir):
    """Level repayment per application at its base rate (360 months), stressed over 240
    months, and at a zero rate (principal / n)."""
    a = D.applications(spark, sf_dir)
    loan, rate = F.col("requested_loan_amount"), F.col("base_interest_rate").cast("double")
    return a.select(
        "application_id",
        F.round(amortised_repayment(loan, rate, 360), 2).alias("repay_base_360"),
        F.round(amortised_repayment(loan, rate + F.lit(0.03), 240), 2).alias("repay_stressed_240"),
        F.round(amortised_repayment(loan, F.lit(0.0), 360), 2).alias("repay_zero_rate"),
    )


@query("quarantine")
def quarantine(spark, sf_dir):
    """Rows that cannot be assessed, with every reason."""
    _, rejected = split_quarantine(D.dirty_applications(spark, sf_dir))
    return rejected.select("application_id", F.array_join("reject_reasons", ",").alias("reject_reasons"))


@query("notes_default")
def notes_default(spark, sf_dir):
    """Absent notes take the default sentence."""
    return with_notes_default(D.applications(spark, sf_dir)).select("application_id", "applicant_notes")


# --- privacy -------------------------------------------------------------------------------------
@query("masked_names")
def masked_names(spark, sf_dir):
    """P9 + P10 on applications with planted blank / null names."""
    a = D.dirty_applications(spark, sf_dir)
    return a.select("application_id", privacy.mask_name("applicant_name").alias("masked_name"),
                    privacy.mask_text("applicant_notes", "applicant_name").alias("masked_notes"))


@query("masked_documents")
def masked_documents(spark, sf_dir):
    """P10: structured PII masked in whole documents."""
    d = D.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", mask_pii("text").alias("masked_text"))


@query("masked_people")
def masked_people(spark, sf_dir):
    """P10: structured PII and every name of the directory masked in whole documents that name customers."""
    # Both are written: Catalyst would otherwise paste the closing line and the patterns into every use of the text.
    d = materialize(D.reviewed_documents(spark, sf_dir), "reviewed")
    d = materialize(d.select("doc_id", mask_pii("text").alias("masked_text")), "masked")
    return people.mask_people(d, D.directory(spark, sf_dir), "masked_text")


@query("people_in_documents")
def people_in_documents(spark, sf_dir):
    """Documents and mentions per directory name that documents hold."""
    found = people.find_people(D.reviewed_documents(spark, sf_dir), D.directory(spark, sf_dir), "text", ("doc_id",))
    return found.groupBy("person").agg(F.count_distinct("doc_id").alias("n_documents"),
                                       F.count(F.lit(1)).alias("n_mentions"))


@query("reidentified")
def reidentified(spark, sf_dir):
    """J1 + P12: console names for the latest ledger rows."""
    r = privacy.reidentify(ledger.latest(D.ledger(spark, sf_dir)), D.directory(spark, sf_dir))
    return r.select("application_id", "display_name", "detail_name")


@query("leak_audit")
def leak_audit(spark, sf_dir):
    """Raw vs masked text columns checked for names (own and other people's) and PII patterns; the notes
    name a guarantor.  ``own_masked_notes`` went without the directory."""
    a = D.applications(spark, sf_dir).join(D.guarantors(spark, sf_dir), "application_id", "left")
    notes = F.concat("applicant_notes", F.lit("; guarantor "), F.coalesce("guarantor", F.lit("none")))
    a = a.select("application_id", "applicant_name", notes.alias("raw_notes"), notes.alias("applicant_notes"))
    a = a.withColumn("own_masked_notes", privacy.mask_text("raw_notes", "applicant_name"))
    rows = privacy.mask_applications(a, D.directory(spark, sf_dir)).withColumnsRenamed(
        {"applicant_notes": "masked_notes", "applicant_name": "masked_name"})
    return privacy.leak_audit(rows, D.directory(spark, sf_dir),
                              ["raw_notes", "own_masked_notes", "masked_notes", "masked_name"])


@query("directory_mismatch")
def directory_mismatch(spark, sf_dir):
    """Payload name differs from the directory's."""
    return privacy.directory_mismatch(D.applications(spark, sf_dir), D.directory(spark, sf_dir)).select(
        "application_id", "applicant_name", "real_name")


@query("submission_split")
def submission_split(spark, sf_dir):
    """S4 + Z2 (batch form): where every submitted payload goes - the ledger, or the rejects and why."""
    valid, rejected = split_quarantine(D.submissions(spark, sf_dir))
    first, repeated = split_duplicates(valid)
    out = first.withColumn("outcome", F.lit("ledger")).select("application_id", "requested_loan_amount", "outcome")
    for side in (rejected, repeated):
        out = out.unionByName(side.select("application_id", "requested_loan_amount",
                                          F.array_join("reject_reasons", ",").alias("outcome")))
    return out.withColumn("requested_loan_amount", F.col("requested_loan_amount").cast("double"))


@query("stream_submissions")
def stream_submissions(spark, sf_dir):
    """S1 + S4 + Z1 + Z2: submissions written as JSON payloads in two rounds, each assessed as a stream on the state the
    round before left; how many of an application's payloads went where."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    raw, led, rejects, state = (f"{root}/{x}" for x in ("raw", "ledger", "rejects", "state"))
    sent = D.submissions(spark, sf_dir).withColumn("_round", F.pmod(F.xxhash64("application_id", F.monotonically_increasing_id()), F.lit(2)))
    sent = materialize(sent, "sent")
    for i in range(2):
        sent.where(F.col("_round") == i).drop("_round").write.mode("append").json(raw)
        stream.finish(stream.assess_stream(spark, raw, led, rejects, state, multi_line=False))
    landed = ledger.read_ledger(spark, led).select("application_id", F.lit("ledger").alias("outcome"))
    refused = (spark.read.schema("application_id string, reject_reasons array<string>").parquet(rejects)
               .select("application_id", F.array_join("reject_reasons", ",").alias("outcome")))
    return landed.unionByName(refused).groupBy("application_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("live_counts")
def live_counts(spark, sf_dir):
    """A1 + Z4: the ledger arrives in two rounds; the dashboard's counts from the signed changes of both."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    rows, counts = D.ledger(spark, sf_dir), f"{root}/counts"
    for i in range(2):
        rows.where(F.col("event_id") % 2 == i).write.mode("append").parquet(f"{root}/ledger")
        stream.finish(stream.live_counts_stream(spark, f"{root}/ledger", counts, f"{root}/state"))
    return dashboard.counts_of(stream.read_counts(spark, counts))


@query("ledger_round_trip")
def ledger_round_trip(spark, sf_dir):
    """K1 + K2 + U2: a run's ledger rows written to an own ledger, written again (a retry) and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgers/{uuid.uuid4().hex}"
    ledger.ensure_ledger(spark, path)
    rows = ledger.audit_rows(policy.with_outcome(assessed(spark, sf_dir)), RUN_TS).orderBy("application_id")
    for _ in range(2):
        back = ledger.append(rows, path, run=7)
    return back.select("event_id", *LEDGER_OUT[1:])


@query("sql_functions")
def sql_functions(spark, sf_dir):
    """The calculators called by name from SQL."""
    register_sql_functions(spark)
    D.applications(spark, sf_dir).createOrReplaceTempView("d1_applications")
    return spark.sql("""
        SELECT application_id,
               dti_of(gross_annual_income, requested_loan_amount, existing_debts_monthly) AS dti,
               dti_status_of(gross_annual_income, requested_loan_amount, existing_debts_monthly) AS dti_status,
               CAST(applicable_expense_of(declared_living_expenses, cdr_verified_expenses_monthly) AS DOUBLE) AS expense,
               round(repayment_of(requested_loan_amount, base_interest_rate, 360), 2) AS repayment
        FROM d1_applications""")


# --- ledger --------------------------------------------------------------------------------------
@query("ledger_latest")
def ledger_latest(spark, sf_dir):
    """Newest row per application (window, partial WindowGroupLimit)."""
    return ledger.latest(D.ledger(spark, sf_dir)).select(*LEDGER_OUT)


@query("ledger_latest_agg")
def ledger_latest_agg(spark, sf_dir):
    """A2: the same rows by max_by aggregation."""
    return ledger.latest_agg(D.ledger(spark, sf_dir)).select(*LEDGER_OUT)


@query("ledger_point")
def ledger_point(spark, sf_dir):
    """S10 + T1: newest row of one application."""
    return ledger.point(D.ledger(spark, sf_dir), POINT_ID).select(*LEDGER_OUT)


@query("ledger_newest")
def ledger_newest(spark, sf_dir):
    """Newest row of the whole ledger."""
    return ledger.newest_overall(D.ledger(spark, sf_dir)).select(*LEDGER_OUT)


@query("dashboard_scan")
def dashboard_scan(spark, sf_dir):
    """The console's narrow ledger scan."""
    return ledger.dashboard_scan(D.ledger(spark, sf_dir))


def _console_rows(spark, sf_dir):
    """The columns the console needs of a row and of its order: the scan reads no others."""
    return ledger.dashboard_scan(D.ledger(spark, sf_dir), "event_id")


@query("dashboard_counts")
def dashboard_counts(spark, sf_dir):
    """A1: counts over the latest state."""
    return dashboard.counts(ledger.latest(_console_rows(spark, sf_dir)))


def _queue(which):
    def q(spark, sf_dir):
        return dashboard.queue(ledger.latest(_console_rows(spark, sf_dir)), which)
    q.__doc__ = f"F2: the {which} queue over the latest state."
    return q


for _w in ("PENDING", "APPROVED", "DECLINED"):
    query(f"queue_{_w.lower()}")(_queue(_w))


@query("hidden_decisions")
def hidden_decisions(spark, sf_dir):
    """Human decisions hidden by a later system re-run."""
    return ledger.hidden_decisions(D.ledger(spark, sf_dir))


@query("decision_valid")
def decision_valid(spark, sf_dir):
    """P13 + P14: label and note validation of every decision."""
    return decisions.validate(D.decisions(spark, sf_dir)).select(
        "decision_id", "application_id", "action", "clean_notes", "notes_valid")


def _gate_rows(spark, sf_dir):
    return D.ledger(spark, sf_dir).select("application_id", "event_id", "timestamp", "underwriter_decision")


@query("decision_gate")
def decision_gate(spark, sf_dir):
    """Valid decisions whose application's newest row before them is pending review."""
    passed, _ = decisions.gate(D.decisions(spark, sf_dir), _gate_rows(spark, sf_dir))
    return passed.select("decision_id", "application_id", "decision", "clean_notes")


@query("decision_rejected")
def decision_rejected(spark, sf_dir):
    """J3 + P14: decisions that cannot land, with the reason."""
    _, rejected = decisions.gate(D.decisions(spark, sf_dir), _gate_rows(spark, sf_dir))
    return rejected.select("decision_id", "application_id", "reject_reason")


@query("ledger_update")
def ledger_update(spark, sf_dir):
    """K3(a) + J5: accepted decisions applied to every row of their application."""
    led = D.ledger(spark, sf_dir)
    acc = decisions.accepted(D.decisions(spark, sf_dir), _gate_rows(spark, sf_dir))
    return ledger.update_in_place(led, acc).select(*LEDGER_OUT)


@query("ledger_decided_state")
def ledger_decided_state(spark, sf_dir):
    """K3(b): latest state after appending HUMAN decision events (checked against the latest
    state of the in-place update)."""
    led = D.ledger(spark, sf_dir)
    acc = decisions.accepted(D.decisions(spark, sf_dir), _gate_rows(spark, sf_dir))
    ev = ledger.decision_events(led, acc, base_event_id=10**12)
    return ledger.latest_agg(led.unionByName(ev)).select(*STATE_OUT)


@query("ledger_reset")
def ledger_reset(spark, sf_dir):
    """K4(a): every non-AUTO_APPROVE row back to pending."""
    return ledger.reset_in_place(D.ledger(spark, sf_dir)).select(*LEDGER_OUT)


@query("ledger_reset_state")
def ledger_reset_state(spark, sf_dir):
    """K4(b): latest state after RESET events (checked against the in-place reset)."""
    led = D.ledger(spark, sf_dir)
    ev = ledger.reset_events(led, RUN_TS, base_event_id=10**12)
    return ledger.latest_agg(led.unionByName(ev)).select(*STATE_OUT)


@query("decisions_daily")
def decisions_daily(spark, sf_dir):
    """Z3 (batch form): decision counts per day."""
    return dashboard.decisions_per_window(D.ledger(spark, sf_dir), "1 day")


# --- guard ---------------------------------------------------------------------------------------
@query("scope_guard")
def scope_guard(spark, sf_dir):
    """Scope family of every user turn, strict and fixed pattern sets."""
    return guard.classify(D.chat(spark, sf_dir)).select("conv_id", "turn", "family_strict", "family_fixed")


@query("guarded_answers")
def guarded_answers(spark, sf_dir):
    """Refusal for blocked prompts, the following answer otherwise."""
    return guard.guarded_answers(D.chat(spark, sf_dir))


# --- memo ----------------------------------------------------------------------------------------
@query("copilot_answers")
def copilot_answers(spark, sf_dir):
    """P16 + P17 + P22 + P23: every user turn's reply - the refusal, the flattened completion or the error."""
    c = guard.classify(D.chat(spark, sf_dir))
    a = memo.copilot_answers(c.filter(~F.col("blocked_strict")), D.chat_completions(spark, sf_dir))
    refused = c.filter(F.col("blocked_strict")).select("conv_id", "turn", F.lit(P.SCOPE_REFUSAL).alias("answer"))
    return a.select("conv_id", "turn", "answer").unionByName(refused)


@query("completion_fallback")
def completion_fallback(spark, sf_dir):
    """J4 + P21 + P23: breached applications joined to their completions, with fallback."""
    _, breached = policy.route(assessed(spark, sf_dir))
    m = memo.attach_completions(breached.select("application_id"), D.completions(spark, sf_dir))
    return m.select("application_id", "ai_risk_memo", "completion_failed")


# --- portfolio jobs ------------------------------------------------------------------------------
@query("cdr_expenses")
def cdr_expenses(spark, sf_dir):
    """Verified expense derived from line-item spend."""
    return D.applications(spark, sf_dir).select(
        "application_id", F.col("cdr_verified_expenses_monthly").cast("double").alias("cdr_verified_expenses_monthly"))


# Stress scenarios (id, serviceability buffer, DTI ceiling).
SCENARIOS = tuple(
    (i + 1, b, lim) for i, (b, lim) in enumerate(
        (b, lim) for b in (0.01, 0.02, 0.03, 0.04, 0.05) for lim in (6.0, 7.0))
)


@query("stress_grid")
def stress_grid(spark, sf_dir):
    """Breach counts per stress scenario, one pass over the applications."""
    return portfolio.stress_grid(D.applications(spark, sf_dir), SCENARIOS)


# 50 buffers by 40 ceilings.
SURFACE = tuple((i + 1, (i // 40) / 1000, 2.0 + (i % 40) / 4) for i in range(2000))


@query("stress_surface")
def stress_surface(spark, sf_dir):
    """Breach counts of 2,000 stress scenarios by dominance counting."""
    return portfolio.stress_surface(D.applications(spark, sf_dir), SURFACE)


@query("breach_mix")
def breach_mix(spark, sf_dir):
    """Breach codes by segment with rollup subtotals."""
    return dashboard.breach_mix(assessed(spark, sf_dir))


# --- retrieval -----------------------------------------------------------------------------------
KNN_K = 10


@query("chunks_fixed")
def chunks_fixed(spark, sf_dir):
    """R2: fixed-stride chunks of every corpus page."""
    c = chunking.chunk_fixed(D.corpus(spark, sf_dir))
    return c.select("page", "chunk_no", "chunk")


@query("chunks_recursive")
def chunks_recursive(spark, sf_dir):
    """Recursive-separator chunks of every corpus page (Arrow UDF)."""
    c = chunking.chunk_recursive(D.corpus(spark, sf_dir))
    return c.select("page", "chunk_no", "chunk")


@query("knn_exact")
def knn_exact(spark, sf_dir):
    """J2 + T2: exact 10 nearest other vectors of every vector (blocked top-k, squared L2)."""
    v = D.vectors(spark, sf_dir)
    hits = knn(v, v, KNN_K, query_id="vec_id", query_vec="embedding", corpus_id="vec_id",
               corpus_vec="embedding", exclude_self=True)
    return hits.withColumn("distance", F.round("distance", 6))


def _pivot_hits(spark, sf_dir, metric):
    v = D.vectors(spark, sf_dir)
    hits = pivot_knn(v, v, KNN_K, query_id="vec_id", query_vec="embedding", corpus_id="vec_id",
                     corpus_vec="embedding", exclude_self=True, metric=metric)
    return hits.withColumn("distance", F.round("distance", 6))


@query("knn_pivot")
def knn_pivot(spark, sf_dir):
    """J2 + T2: the same neighbours as ``knn_exact``, by cells with triangle-inequality bounds."""
    return _pivot_hits(spark, sf_dir, "l2")


@query("knn_cosine")
def knn_cosine(spark, sf_dir):
    """Exact 10 nearest other vectors by cosine (distance: one minus it)."""
    return _pivot_hits(spark, sf_dir, "cosine")


@query("knn_inner")
def knn_inner(spark, sf_dir):
    """Exact 10 nearest other vectors by inner product (distance: its negative)."""
    return _pivot_hits(spark, sf_dir, "inner")


@query("knn_lsh")
def knn_lsh(spark, sf_dir):
    """J2 at scale: approximate 10 nearest other vectors by random-projection LSH with exact
    re-ranking of candidates (rows-only check; recall against knn_exact in the tests)."""
    v = D.vectors(spark, sf_dir)
    hits = lsh_knn(v, v, KNN_K, query_id="vec_id", query_vec="embedding", corpus_id="vec_id",
                   corpus_vec="embedding", exclude_self=True)
    return hits.withColumn("distance", F.round("distance", 6))


@query("citations")
def citations(spark, sf_dir):
    """Top-3 neighbours of every vector rendered as citation text (vector i indexes
    corpus page i; a vector without a page renders the Unknown defaults)."""
    v = D.vectors(spark, sf_dir)
    hits = knn(v, v, P.RETRIEVAL_K_DEFAULT, query_id="vec_id", query_vec="embedding", corpus_id="vec_id",
               corpus_vec="embedding", exclude_self=True)
    pages = D.corpus(spark, sf_dir)
    h = hits.join(pages, hits.neighbor_id == pages.page, "left")
    return retrieval.render_citations(h)


@query("retrieve_text")
def retrieve_text(spark, sf_dir):
    """R3 + R4 + P11: every breached application's breach text retrieves its 2 best corpus
    chunks (recursive chunks, TF-IDF cosine over an inverted index) as citation text."""
    _, breached = policy.route(assessed(spark, sf_dir))
    q = materialize(breached.select("application_id", retrieval.query_text().alias("query_text")), "breached")
    chunks, index = retrieval.build_index(D.corpus(spark, sf_dir), inverted.vocabulary(q, "query_text"))
    out = retrieval.retrieve_for_texts(q, chunks, index, k=P.RETRIEVAL_K)
    return out.select("application_id", "regulatory_citations")


@query("memo_prompts")
def memo_prompts(spark, sf_dir):
    """P11 + P18 + P19 + J4 + R4: for every breached application, the notes-summary prompt and
    the credit-memo prompt (narrative = summary completion or its fallback sentence; citations =
    the 2 best corpus chunks for the breach text)."""
    _, breached = policy.route(assessed(spark, sf_dir))
    summaries = memo.attach_completions(breached.select("application_id"), D.completions(spark, sf_dir),
                                        fallback=P.SUMMARY_FALLBACK, out="applicant_narrative_summary")
    b = breached.join(summaries, "application_id", "left").select(*MEMO_COLUMNS, "applicant_notes",
                                                                  retrieval.query_text().alias("query_text"))
    b = materialize(b, "breached")          # feeds the distinct texts and the prompts
    chunks, index = retrieval.build_index(D.corpus(spark, sf_dir), inverted.vocabulary(b, "query_text"))
    b = retrieval.retrieve_for_texts(b, chunks, index, k=P.RETRIEVAL_K)
    return b.select("application_id", memo.summary_prompt().alias("summary_prompt"),
                    F.lit(P.MEMO_SYSTEM_PROMPT).alias("system_prompt"), memo.memo_prompt().alias("memo_prompt"))


@query("summary_prompts")
def summary_prompts(spark, sf_dir):
    """P19 + P10 + S2: the notes-summary prompt of every application (notes masked, absent
    notes defaulted)."""
    a = privacy.mask_applications(D.applications(spark, sf_dir))
    return a.select("application_id", memo.summary_prompt().alias("summary_prompt"))


@query("copilot_prompts")
def copilot_prompts(spark, sf_dir):
    """P16 + P17 + P20 + J1 + S10 + T2: every user turn is guarded; allowed questions get the
    copilot prompt (latest ledger row of the conversation's application, directory name, the 2
    best corpus chunks for the question)."""
    c = guard.classify(D.chat(spark, sf_dir)).withColumn("application_id", D.app_id("conv_id"))
    lat = ledger.latest(D.ledger(spark, sf_dir).select("application_id", "event_id", "timestamp", *PROMPT_COLUMNS))
    lat = lat.drop("event_id", "timestamp")
    dirn = D.directory(spark, sf_dir)
    j = c.join(lat, "application_id", "left").join(dirn, "application_id", "left")
    j = j.withColumn("display_name", F.coalesce("real_name", "applicant_name", F.lit(P.UNKNOWN_APPLICANT)))
    allowed = materialize(j.filter(~F.col("blocked_strict")).withColumn("query_text", F.col("text")), "allowed")
    chunks, index = retrieval.build_index(D.corpus(spark, sf_dir), inverted.vocabulary(allowed, "query_text"))
    allowed = retrieval.retrieve_for_texts(allowed, chunks, index, k=P.RETRIEVAL_K)
    allowed = allowed.withColumn("question", F.col("text"))
    ok = allowed.select("conv_id", "turn", F.lit(False).alias("blocked"),
                        F.lit(P.COPILOT_SYSTEM_PROMPT).alias("system_prompt"),
                        memo.copilot_prompt().alias("prompt"), F.lit(None).cast("string").alias("reply"))
    refused = j.filter(F.col("blocked_strict")).select(
        "conv_id", "turn", F.lit(True).alias("blocked"), F.lit(None).cast("string").alias("system_prompt"),
        F.lit(None).cast("string").alias("prompt"), F.lit(P.SCOPE_REFUSAL).alias("reply"))
    return ok.unionByName(refused)


LEXICAL_K = 3


def _fixed_chunks(spark, sf_dir):
    """Fixed-stride chunks of the corpus, written once and numbered in (page, chunk) order."""
    chunks = chunking.chunk_fixed(D.corpus(spark, sf_dir).repartitionByRange("page"))
    return numbered(chunks.sortWithinPartitions("page", "chunk_no"), name="chunk_id").withColumnRenamed("chunk", "content")


def _lexical_citations(rows, chunks, qid="qid"):
    """``rows`` with the citations of the chunks that rank best for their text."""
    best, members = lexical_groups(rows.select(qid, "query_text"), chunks.select("chunk_id", "content"), P.RETRIEVAL_K,
                                   query_id=qid, query_text="query_text", doc_id="chunk_id", doc_text="content")
    lists, texts = retrieval.cited(best, chunks)
    found = members.join(lists, "rep").select(F.col("query_id").alias(qid), "cited")
    return rows.join(found, qid, "left").join(texts, "cited", "left")


@query("memo_prompts_lexical")
def memo_prompts_lexical(spark, sf_dir):
    """P11 + P18 + J4 + P23 + R2 + R5 + P24: every breached application's memo prompt, its breach
    text ranking the fixed-stride chunks by TF-IDF (best 2 cited) and its narrative taken from the
    summary completion or the fallback sentence."""
    _, breached = policy.route(assessed(spark, sf_dir))
    summaries = memo.attach_completions(breached.select("application_id"), D.completions(spark, sf_dir),
                                        fallback=P.SUMMARY_FALLBACK, out="applicant_narrative_summary")
    b = breached.join(summaries.select("application_id", "applicant_narrative_summary"), "application_id", "left")
    b = b.withColumn("qid", F.substring("application_id", len(D.APP_PREFIX) + 1, 20).cast("long"))
    b = b.select(*MEMO_COLUMNS, "qid", retrieval.query_text().alias("query_text"))
    b = materialize(b, "breached")          # feeds the ranking's statistics, its scores and the prompts
    b = _lexical_citations(b, _fixed_chunks(spark, sf_dir))
    return b.select("application_id", memo.memo_prompt().alias("memo_prompt"))


@query("copilot_prompts_lexical")
def copilot_prompts_lexical(spark, sf_dir):
    """P16 + P17 + P20 + J1 + S10 + R2 + R5 + P24: the copilot flow with lexical retrieval - each
    allowed question ranks the fixed-stride chunks by TF-IDF and cites the best 2."""
    c = numbered(guard.classify(D.chat(spark, sf_dir)).orderBy("conv_id", "turn"), name="qid")
    c = c.withColumn("application_id", D.app_id("conv_id"))
    lat = ledger.latest(D.ledger(spark, sf_dir).select("application_id", "event_id", "timestamp", *PROMPT_COLUMNS))
    lat = lat.drop("event_id", "timestamp")
    j = c.join(lat, "application_id", "left").join(D.directory(spark, sf_dir), "application_id", "left")
    j = j.withColumn("display_name", F.coalesce("real_name", "applicant_name", F.lit(P.UNKNOWN_APPLICANT)))
    allowed = materialize(j.filter(~F.col("blocked_strict")).withColumn("query_text", F.col("text")), "allowed")
    allowed = _lexical_citations(allowed, _fixed_chunks(spark, sf_dir))
    ok = allowed.withColumn("question", F.col("text")).select(
        "conv_id", "turn", F.lit(False).alias("blocked"), F.lit(P.COPILOT_SYSTEM_PROMPT).alias("system_prompt"),
        memo.copilot_prompt().alias("prompt"), F.lit(None).cast("string").alias("reply"))
    refused = j.filter(F.col("blocked_strict")).select(
        "conv_id", "turn", F.lit(True).alias("blocked"), F.lit(None).cast("string").alias("system_prompt"),
        F.lit(None).cast("string").alias("prompt"), F.lit(P.SCOPE_REFUSAL).alias("reply"))
    return ok.unionByName(refused)


@query("retrieve_lexical")
def retrieve_lexical(spark, sf_dir):
    """Every benchmark passage ranks the corpus pages by TF-IDF dot product; top 3."""
    b = D.read_table(spark, sf_dir, "benchmark", "item_id", "text")
    d = D.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return lexical_topk(b, d, LEXICAL_K, query_id="item_id", query_text="text", doc_id="doc_id", doc_text="text")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
