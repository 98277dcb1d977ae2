"""Policy gate, recommendation, routing and the auto-approve projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendflow import params as P
from lendflow.functions.metrics import with_metrics
from lendflow.functions.text import fmt_calc, fmt_in, pct2


def dti_message(dti_col="dti_result") -> F.Column:
    """``DTI Breach: 6.71x (Ceiling: 6.0x)``."""
    d = F.col(dti_col)
    return F.concat(F.lit("DTI Breach: "), fmt_calc(d.calculated_dti), F.lit("x (Ceiling: "),
                    fmt_calc(d.apra_limit), F.lit("x)"))


def expense_message(declared="declared_living_expenses", actual="cdr_verified_expenses_monthly") -> F.Column:
    """``Living Expense Discrepancy: Declared $1600 vs Actual $3450``."""
    return F.concat(F.lit("Living Expense Discrepancy: Declared $"), fmt_in(declared),
                    F.lit(" vs Actual $"), fmt_in(actual))


def surplus_message(svc_col="serviceability_result") -> F.Column:
    """``Net Serviceability Deficit: Stressed surplus is -$509.52/mo at stressed rate of 9.35%``."""
    s = F.col(svc_col)
    return F.concat(F.lit("Net Serviceability Deficit: Stressed surplus is -$"),
                    fmt_calc(F.abs(s.net_monthly_surplus)), F.lit("/mo at stressed rate of "),
                    pct2(s.stressed_interest_rate), F.lit("%"))


def with_policy(df: DataFrame) -> DataFrame:
    """P5 + P6 on a DataFrame that already has the metric structs.

    ``policy_breaches``: messages in the order DTI, expense, serviceability, only for BREACH;
    ``breach_codes``: the parallel codes; ``system_recommendation`` from their presence."""
    flags = (
        (F.col("dti_result.status") == P.BREACH, dti_message(), P.BREACH_CODES[0]),
        (F.col("expense_result.status") == P.BREACH, expense_message(), P.BREACH_CODES[1]),
        (F.col("serviceability_result.status") == P.BREACH, surplus_message(), P.BREACH_CODES[2]),
    )
    df = df.withColumns({
        "policy_breaches": F.array_compact(F.array(*[F.when(c, m) for c, m, _ in flags])),
        "breach_codes": F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, _, code in flags])),
    })
    # The recommendation reads the codes, not the messages (both are empty together), so a query
    # that never selects the messages does not pay for formatting them.
    return df.withColumn(
        "system_recommendation",
        F.when(F.size("breach_codes") > 0, F.lit(P.ESCALATED_REFERRAL)).otherwise(F.lit(P.AUTO_APPROVE)),
    )


def assess(apps: DataFrame, p=P.DEFAULT_POLICY) -> DataFrame:
    """P4 -> P5 -> P6 as one chain of projections (a single narrow stage)."""
    return with_policy(with_metrics(apps, p))


# --- P7 / P8 / U1 --------------------------------------------------------------------------------
def is_clean() -> F.Column:
    return F.size("breach_codes") == 0


def route(assessed: DataFrame):
    """(clean, breached).  Persist ``assessed`` before consuming both halves."""
    return assessed.filter(is_clean()), assessed.filter(~is_clean())


def auto_memo(id_col="application_id") -> F.Column:
    head, tail = P.AUTO_MEMO_TEMPLATE.split("{id}")
    return F.concat(F.lit(head), F.col(id_col), F.lit(tail))


def auto_approve(clean: DataFrame) -> DataFrame:
    """P8 on the clean branch: fixed memo and system decision."""
    return clean.withColumns({
        "ai_risk_memo": auto_memo(),
        "underwriter_id": F.lit(P.SYSTEM_UNDERWRITER),
        "underwriter_decision": F.lit(P.AUTO_APPROVED),
        "underwriter_notes": F.lit(P.AUTO_NOTES),
    })


def with_outcome(assessed: DataFrame) -> DataFrame:
    """U1 without a split: P8's columns as ``when`` columns on the one DataFrame (null on the
    breached branch, where the memo arrives from a completion and the decision stays pending).
    Equal to ``union_outcome`` but scans once."""
    clean = is_clean()
    return assessed.withColumns({
        "ai_risk_memo": F.when(clean, auto_memo()),
        "underwriter_id": F.when(clean, F.lit(P.SYSTEM_UNDERWRITER)),
        "underwriter_decision": F.when(clean, F.lit(P.AUTO_APPROVED)),
        "underwriter_notes": F.when(clean, F.lit(P.AUTO_NOTES)),
    })


def union_outcome(assessed: DataFrame) -> DataFrame:
    """U1 as the reference shapes it: two branches that meet again before the audit stage."""
    clean, breached = route(assessed)
    return auto_approve(clean).unionByName(breached, allowMissingColumns=True)
