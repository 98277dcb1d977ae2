"""Affordability metrics as native Column expressions.

All three metrics stay inside whole-stage codegen: no Python runs per row.  Ratios and the
amortisation power work in double (as the calculators do); expense amounts stay
``decimal(18,2)`` so that the discrepancy is exact.  Status flags read the *unrounded* values;
only the displayed numbers are rounded.

Policy values may be plain numbers (``PolicyParams``) or Columns (a scenario table, X2).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lendflow.params import BREACH, DEFAULT_POLICY, PASS
from lendflow.sources.schemas import MONEY


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _v(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _dbl(x) -> Column:
    return _c(x).cast("double")


def _status(breach: Column) -> Column:
    return F.when(breach, F.lit(BREACH)).otherwise(F.lit(PASS))


def exact_cents(x) -> Column:
    """A double amount in whole cents as a long, exactly ``cast(x as decimal(18,2)) * 100``.

    Fast path: for |x*100| < 1e9 the product's rounding error is below 1e-7 and the double's
    distance to its decimal form below 1e-9; so when x*100 is within 1e-6 of an integer n, the
    amount's decimal form is nowhere near a half-cent tie and the cast's rounding gives n.  Larger
    or off-cent amounts take the cast (which goes through BigDecimal for every row)."""
    x100 = _dbl(x) * F.lit(100.0)
    fast = (F.abs(x100) < F.lit(1e9)) & (F.abs(x100 - F.rint(x100)) < F.lit(1e-6))
    return F.when(fast, F.rint(x100).cast("long")).otherwise((_c(x).cast(MONEY) * F.lit(100)).cast("long"))


# --- P1 ---------------------------------------------------------------------------------------
def dti_raw(income, loan, debts, p=DEFAULT_POLICY) -> Column:
    """(loan + monthly debts capitalised over ``debt_years``) / gross income, unrounded."""
    principal = _dbl(debts) * F.lit(12.0) * _v(p.debt_years).cast("double")
    return F.try_divide(_dbl(loan) + principal, _dbl(income))


def dti(income, loan, debts, p=DEFAULT_POLICY) -> Column:
    raw = dti_raw(income, loan, debts, p)
    limit = _v(p.dti_limit).cast("double")
    return F.struct(
        F.round(raw, 2).alias("calculated_dti"),
        limit.alias("apra_limit"),
        _status(raw >= limit).alias("status"),
    )


# --- P2 ---------------------------------------------------------------------------------------
def expenses(declared, verified, p=DEFAULT_POLICY) -> Column:
    """Applicable expense = max(declared, verified, HEM floor); breach if verified exceeds
    declared by more than the tolerance (one-sided)."""
    declared_m, verified_m = _c(declared).cast(MONEY), _c(verified).cast(MONEY)
    hem = _v(p.hem).cast(MONEY)
    delta = (verified_m - declared_m).cast(MONEY)
    return F.struct(
        F.greatest(declared_m, verified_m, hem).cast(MONEY).alias("applicable_monthly_expense"),
        hem.alias("hem_benchmark"),
        delta.alias("expense_discrepancy"),
        _status(delta > _v(p.expense_tolerance).cast(MONEY)).alias("status"),
    )


# --- P3a --------------------------------------------------------------------------------------
def amortised_repayment(principal, annual_rate, months) -> Column:
    """Level monthly repayment P*r(1+r)^n / ((1+r)^n - 1), r = annual_rate/12; P/n when r = 0."""
    r = _dbl(annual_rate) / F.lit(12.0)
    n = _dbl(_v(months) if not isinstance(months, str) else F.col(months))
    growth = F.pow(F.lit(1.0) + r, n)
    return F.when(r == 0, F.try_divide(_dbl(principal), n)).otherwise(
        F.try_divide(_dbl(principal) * (r * growth), growth - F.lit(1.0))
    )


# --- P3 ---------------------------------------------------------------------------------------
def serviceability_raw(income, applicable, debts, loan, base_rate, p=DEFAULT_POLICY):
    """(stressed rate, repayment, surplus), all unrounded doubles."""
    net_income = _dbl(income) * _v(p.net_ratio).cast("double") / F.lit(12.0)
    stressed = _dbl(base_rate) + _v(p.buffer).cast("double")
    repay = amortised_repayment(loan, stressed, _v(p.months))
    surplus = net_income - _dbl(applicable) - _dbl(debts) - repay
    return stressed, repay, surplus


def serviceability(income, applicable, debts, loan, base_rate, p=DEFAULT_POLICY) -> Column:
    stressed, repay, surplus = serviceability_raw(income, applicable, debts, loan, base_rate, p)
    return F.struct(
        F.round(stressed, 4).alias("stressed_interest_rate"),
        F.round(repay, 2).alias("stressed_monthly_repayment"),
        F.round(surplus, 2).alias("net_monthly_surplus"),
        _status(surplus < 0).alias("status"),
    )


# --- P4 ---------------------------------------------------------------------------------------
def with_metrics(df, p=DEFAULT_POLICY):
    """Chain the three metrics; P2's applicable expense feeds P3.  One projection, no shuffle."""
    df = df.withColumns({
        "dti_result": dti("gross_annual_income", "requested_loan_amount", "existing_debts_monthly", p),
        "expense_result": expenses("declared_living_expenses", "cdr_verified_expenses_monthly", p),
    })
    return df.withColumn(
        "serviceability_result",
        serviceability("gross_annual_income", F.col("expense_result.applicable_monthly_expense"),
                       "existing_debts_monthly", "requested_loan_amount", "base_interest_rate", p),
    )


METRIC_COLUMNS = {
    "calculated_dti": "dti_result.calculated_dti",
    "dti_status": "dti_result.status",
    "applicable_monthly_expense": "expense_result.applicable_monthly_expense",
    "expense_discrepancy": "expense_result.expense_discrepancy",
    "expense_status": "expense_result.status",
    "stressed_interest_rate": "serviceability_result.stressed_interest_rate",
    "stressed_monthly_repayment": "serviceability_result.stressed_monthly_repayment",
    "net_monthly_surplus": "serviceability_result.net_monthly_surplus",
    "serviceability_status": "serviceability_result.status",
}


def flat_metrics(df):
    """Metric struct fields as top-level columns."""
    return df.withColumns({k: F.col(v) for k, v in METRIC_COLUMNS.items()})


# --- D1 ---------------------------------------------------------------------------------------
def register_sql_functions(spark: SparkSession, p=DEFAULT_POLICY) -> None:
    """The calculators as SQL functions; Catalyst inlines SQL function bodies, so a query that
    calls them keeps codegen, constant folding and column pruning."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION dti_of(income DOUBLE, loan DOUBLE, debts DOUBLE)
        RETURNS DOUBLE RETURN round(try_divide(loan + debts * 12.0D * {float(p.debt_years)}D, income), 2)""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION dti_status_of(income DOUBLE, loan DOUBLE, debts DOUBLE)
        RETURNS STRING RETURN CASE WHEN try_divide(loan + debts * 12.0D * {float(p.debt_years)}D, income)
            >= {float(p.dti_limit)}D THEN 'BREACH' ELSE 'PASS' END""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION applicable_expense_of(declared DECIMAL(18,2), verified DECIMAL(18,2))
        RETURNS DECIMAL(18,2) RETURN CAST(greatest(declared, verified, CAST({p.hem} AS DECIMAL(18,2))) AS DECIMAL(18,2))""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION repayment_of(principal DOUBLE, annual_rate DOUBLE, months INT)
        RETURNS DOUBLE RETURN CASE WHEN annual_rate = 0 THEN principal / months
            ELSE principal * ((annual_rate / 12.0D) * power(1.0D + annual_rate / 12.0D, months))
                 / (power(1.0D + annual_rate / 12.0D, months) - 1.0D) END""")
