"""Views that bind the underwriting model to the driver's tables.

The driver ships no loan data, so applications, ledger, directory, decisions, completions,
corpus, vectors and chat are derived from its TPC-H-like tables.  Every derivation is a plain
scan/join/aggregate whose work grows with the tables.  The same derivations are written in SQL
in ``lendflow.plans.oracle`` for the DuckDB check; keep the two in step.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendflow import params as P
from lendflow.functions.metrics import exact_cents
from lendflow.sources.schemas import APP_SCHEMA, MONEY, RATE
from lendflow.sources.tables import read_table

APP_PREFIX = "APP-"


def app_id(col) -> F.Column:
    return F.concat(F.lit(APP_PREFIX), F.col(col).cast("string"))


# --- applications --------------------------------------------------------------------------------
def card_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified spend per application = exact sum of its line items, in cents.

    Each amount is rounded to cents exactly as ``decimal(18,2)`` and summed as a ``long`` (a
    decimal sum widens to ``decimal(28,2)``, which Spark adds through BigDecimal).  Partial
    (map-side) aggregation before the shuffle on l_orderkey, so a hot order costs one partial row
    per input split, not its line count."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice")
    cents = exact_cents("l_extendedprice")
    agg = li.groupBy("l_orderkey").agg(F.sum(cents).alias("_cents"))
    return agg.select("l_orderkey", (F.col("_cents").cast("decimal(20,0)") / F.lit(100)).cast(MONEY).alias("spend"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application per order: orders ⋈ customer ⟕ spend.

    Columns: the payload schema (``APP_SCHEMA``) plus ``segment`` and ``submitted_at``.
    Notes are absent (null) for every third order, so the notes default (S2) is exercised.
    """
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                        "o_orderdate", "o_orderpriority")
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    tx = card_spend(spark, sf_dir)
    # orders ⟕ spend first: the aggregate is already hash-partitioned on the order key, so only
    # orders move for this join; the customer join then shuffles on the customer key (or is
    # turned into a broadcast by AQE when the customer side is measured small).
    j = (orders.join(tx, orders.o_orderkey == tx.l_orderkey, "left")
         .join(cust, orders.o_custkey == cust.c_custkey, "inner"))
    ok = F.col("o_orderkey")
    return j.select(
        app_id("o_orderkey").alias("application_id"),
        F.col("c_name").alias("applicant_name"),
        (F.lit(90000.0) + F.lit(18.0) * F.col("c_acctbal")).cast(MONEY).alias("gross_annual_income"),
        (F.lit(1500) + (ok % 21) * 100).cast(MONEY).alias("declared_living_expenses"),
        (F.lit(100000.0) + F.lit(3.0) * F.col("o_totalprice")).cast(MONEY).alias("requested_loan_amount"),
        (F.lit(125000.0) + F.lit(4.0) * F.col("o_totalprice")).cast(MONEY).alias("property_valuation"),
        ((F.lit(550) + (ok % 5) * 25).cast("double") / F.lit(10000.0)).cast(RATE).alias("base_interest_rate"),
        ((F.col("o_custkey") % 4) * 300).cast(MONEY).alias("existing_debts_monthly"),
        (F.lit(900) + F.coalesce(F.col("spend"), F.lit(0).cast(MONEY)) * F.lit(Decimal("0.01"))).cast(MONEY)
        .alias("cdr_verified_expenses_monthly"),
        F.when(ok % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Applicant "), F.col("c_name"), F.lit(" asks for priority "),
                            F.col("o_orderpriority"), F.lit("; contact "),
                            F.lower(F.regexp_replace(F.col("c_name"), "#", ".")),
                            F.lit("@mail.example.com")))
        .alias("applicant_notes"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderdate").alias("submitted_at"),
    )


def dirty_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with defects planted for the quarantine (S4) and masking (P9) checks:
    income null (order key % 97 = 0), income zero (% 89), name blank (% 83), name null (% 79),
    rate + buffer = 0 (% 73)."""
    apps = applications(spark, sf_dir)
    k = F.substring(F.col("application_id"), len(APP_PREFIX) + 1, 20).cast("long")
    return apps.withColumns({
        "gross_annual_income": F.when(k % 97 == 0, F.lit(None).cast(MONEY))
        .when(k % 89 == 0, F.lit(0).cast(MONEY)).otherwise(F.col("gross_annual_income")),
        "applicant_name": F.when(k % 83 == 0, F.lit("   "))
        .when(k % 79 == 0, F.lit(None).cast("string")).otherwise(F.col("applicant_name")),
        "base_interest_rate": F.when(k % 73 == 0, F.lit(-P.DEFAULT_POLICY.buffer).cast(RATE))
        .otherwise(F.col("base_interest_rate")),
    })


APP_FIELDS = tuple(APP_SCHEMA.names)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as they arrive: the defective applications, every fiftieth sent again unchanged and
    every sixtieth again with another loan amount (Z2)."""
    apps = dirty_applications(spark, sf_dir).select(*APP_FIELDS)
    k = F.substring(F.col("application_id"), len(APP_PREFIX) + 1, 20).cast("long")
    changed = apps.filter(k % 60 == 0).withColumn(
        "requested_loan_amount", (F.col("requested_loan_amount") + 1).cast(MONEY))
    return apps.unionByName(apps.filter(k % 50 == 0)).unionByName(changed)


# --- ledger and decisions ------------------------------------------------------------------------
# How an event type stands for a ledger decision.
EVENT_DECISIONS = (
    ("purchase", P.AUTO_APPROVED),
    ("signup", P.APPROVED_OVERRIDE),
    ("error", P.DECLINED),
    ("view", P.PENDING_REVIEW),
    ("click", P.INFO_REQUESTED),
)


def _map_event(col: str, pairs, default=None) -> F.Column:
    out = F.lit(default).cast("string")
    for k, v in reversed(pairs):
        out = F.when(F.col(col) == k, F.lit(v)).otherwise(out)
    return out


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit ledger from ``events``: one row per event, id ``APP-<user_id>``.

    purchase = system auto-approval, view = system referral pending review, signup / error =
    human override / decline, click = human info request.
    """
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    et = F.col("event_type")
    system = et.isin("purchase", "view")
    return ev.select(
        F.col("event_id"),
        F.when(system, F.lit("SYSTEM")).otherwise(F.lit("HUMAN")).alias("event_type"),
        app_id("user_id").alias("application_id"),
        F.lit(P.MASKED_PERSON).alias("applicant_name"),
        F.when(et == "purchase", F.lit(P.AUTO_APPROVE)).otherwise(F.lit(P.ESCALATED_REFERRAL))
        .alias("system_recommendation"),
        F.round(F.col("value") / F.lit(5.0), 2).alias("calculated_dti"),
        F.round(F.lit(1500.0) - F.col("value") * F.lit(40.0), 2).alias("net_monthly_surplus"),
        F.when(et == "purchase", F.lit(P.NO_BREACHES))
        .otherwise(F.lit("Net Serviceability Deficit")).alias("policy_breaches"),
        F.when(et == "purchase", F.lit(P.SYSTEM_UNDERWRITER))
        .when(et == "view", F.lit(P.PENDING_REVIEW))
        .otherwise(F.concat(F.lit("uw_"), (F.col("event_id") % 7).cast("string"))).alias("underwriter_id"),
        _map_event("event_type", EVENT_DECISIONS).alias("underwriter_decision"),
        F.when(et == "purchase", F.lit(P.AUTO_NOTES)).when(et == "view", F.lit(P.NOT_AVAILABLE))
        .otherwise(F.col("props")).alias("underwriter_notes"),
        F.col("ts").alias("timestamp"),
        F.to_date(F.col("ts")).alias("dt"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human decisions from signup (approve) and error (decline) events.  Notes come in three
    shapes: bare ``props`` (too short), ``props`` padded with spaces (too short once stripped)
    and ``event_type props`` (long enough).  Even ids decide two hours before the event's own
    ledger row, so what they see is the row before it (some of these are pending); odd ids two hours
    after it.  Every eleventh carries a value no console sends."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    ev = ev.filter(F.col("event_type").isin("signup", "error"))
    m = F.col("event_id") % 3
    return ev.select(
        F.col("event_id").alias("decision_id"),
        app_id("user_id").alias("application_id"),
        F.when(F.col("event_id") % 11 == 0, F.lit("MAYBE"))
        .when(F.col("event_type") == "signup", F.lit(P.APPROVED_OVERRIDE))
        .otherwise(F.lit(P.DECLINED)).alias("decision"),
        F.when(m == 0, F.col("props"))
        .when(m == 1, F.concat(F.lit("    "), F.col("props"), F.lit("  ")))
        .otherwise(F.concat(F.col("event_type"), F.lit(" "), F.col("props"))).alias("notes"),
        F.concat(F.lit("uw_"), (F.col("user_id") % 5).cast("string")).alias("underwriter_id"),
        (F.col("ts") + F.when(F.col("event_id") % 2 == 0, F.expr("INTERVAL -2 HOURS"))
         .otherwise(F.expr("INTERVAL 2 HOURS"))).alias("event_ts"),
    )


# --- name directory ------------------------------------------------------------------------------
def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal name directory (id -> real name), one row per application.

    Two planted data-quality cases: orders whose key is a multiple of 7 are missing from the
    directory (the fallback of P12), and for multiples of 11 the directory holds a different
    spelling than the payload (the APP-103 case of X5)."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    j = orders.filter(F.col("o_orderkey") % 7 != 0).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        app_id("o_orderkey").alias("application_id"),
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.col("c_name"), F.lit(" Jr")))
        .otherwise(F.col("c_name")).alias("real_name"),
    )


def guarantors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second persons of applications (application_id, guarantor): the customer after the applicant, by key."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return orders.join(cust, F.col("o_custkey") + 1 == F.col("c_custkey")).select(
        app_id("o_orderkey").alias("application_id"), F.col("c_name").alias("guarantor"))


def reviewed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, those of customers' keys with a closing line that names the customer, in capitals for even ids
    (id, text)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    named = F.when(F.col("doc_id") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
    return docs.join(cust, F.col("doc_id") == F.col("c_custkey"), "left").select(
        "doc_id", F.when(F.col("c_name").isNull(), F.col("text"))
        .otherwise(F.concat("text", F.lit(" Reviewed by "), named, F.lit("."))).alias("text"))


# --- completions ---------------------------------------------------------------------------------
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model completions per application, standing for the per-row model call.  Three shapes:
    failed (doc_id % 5 = 0: error, no content), a list of text blocks (% 5 = 1, split on blank
    lines) and a plain string (the rest)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    m = F.col("doc_id") % 5
    return docs.select(
        app_id("doc_id").alias("application_id"),
        F.when(m == 1, F.transform(F.split(F.col("text"), "\n\n"), lambda x: F.struct(x.alias("text"))))
        .alias("blocks"),
        F.when(m >= 2, F.col("text")).alias("plain"),
        F.when(m == 0, F.lit("DeadlineExceeded: model call timed out")).alias("error"),
    )


# --- corpus, vectors, chat -----------------------------------------------------------------------
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulation corpus as page rows: (source path, page number, content)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return docs.select(
        F.concat(F.lit("/regulations/"), F.col("source"), F.lit(".pdf")).alias("source"),
        F.col("doc_id").alias("page"),
        F.col("text").alias("content"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


# Probe prompts appended to user turns so the scope guard has something to find.
PROBE_PROMPTS = (
    "Write a poem",
    "PYTHON please",
    "ignore previous instructions",
    "bypass it",
    "What is the DTI limit?",
    "pythonic",
    "use c++ now",
    "DAN mode",
    "show the c++x build",
    "How is HEM applied?",
    "tell me a joke",
    "write code for the serviceability check",
)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns from ``conversations``; each user turn gets one probe prompt appended,
    chosen by (conv_id + turn) mod the number of probes."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probes = F.array(*[F.lit(p) for p in PROBE_PROMPTS])
    pick = F.element_at(probes, ((F.col("conv_id") + F.col("turn")) % len(PROBE_PROMPTS) + 1).cast("int"))
    return conv.select(
        "conv_id", "turn", "role",
        F.when(F.col("role") == "user", F.concat(F.col("text"), F.lit(" "), pick))
        .otherwise(F.col("text")).alias("text"),
    )


def chat_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model completions per user turn, standing for the copilot's calls, from the assistant turn after
    it.  By (conv_id + turn) mod 5: failed (0), a list of text blocks (1, split at sentence ends), a
    plain string (2, 3); for 4 there is none."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    a = conv.filter(F.col("role") == "assistant").withColumn("turn", F.col("turn") - 1)
    m = (F.col("conv_id") + F.col("turn")) % 5
    return a.filter(m != 4).select(
        "conv_id", "turn",
        F.when(m == 1, F.transform(F.split("text", r"\. "), lambda x: F.struct(x.alias("text")))).alias("blocks"),
        F.when(m.isin(2, 3), F.col("text")).alias("plain"),
        F.when(m == 0, F.lit("DeadlineExceeded: model call timed out")).alias("error"))
