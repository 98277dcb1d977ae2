"""Explicit schemas: payloads are never inferred (amounts would read as bigint)."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(9, 6)

# Application payload, field order as submitted.
APP_SCHEMA = T.StructType([
    T.StructField("application_id", T.StringType()),
    T.StructField("applicant_name", T.StringType()),
    T.StructField("gross_annual_income", MONEY),
    T.StructField("declared_living_expenses", MONEY),
    T.StructField("requested_loan_amount", MONEY),
    T.StructField("property_valuation", MONEY),
    T.StructField("base_interest_rate", RATE),
    T.StructField("existing_debts_monthly", MONEY),
    T.StructField("cdr_verified_expenses_monthly", MONEY),
    T.StructField("applicant_notes", T.StringType()),
])

REQUIRED_FIELDS = (
    "application_id", "applicant_name", "gross_annual_income", "declared_living_expenses",
    "requested_loan_amount", "base_interest_rate", "existing_debts_monthly",
    "cdr_verified_expenses_monthly",
)

# Audit ledger: ten reference columns plus event_id (tie-break), event_type and dt (partition).
LEDGER_COLUMNS = (
    "application_id", "applicant_name", "system_recommendation", "calculated_dti",
    "net_monthly_surplus", "policy_breaches", "underwriter_id", "underwriter_decision",
    "underwriter_notes", "timestamp",
)

LEDGER_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("application_id", T.StringType()),
    T.StructField("applicant_name", T.StringType()),
    T.StructField("system_recommendation", T.StringType()),
    T.StructField("calculated_dti", T.DoubleType()),
    T.StructField("net_monthly_surplus", T.DoubleType()),
    T.StructField("policy_breaches", T.StringType()),
    T.StructField("underwriter_id", T.StringType()),
    T.StructField("underwriter_decision", T.StringType()),
    T.StructField("underwriter_notes", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("dt", T.DateType()),
])

DECISION_SCHEMA = T.StructType([
    T.StructField("application_id", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("underwriter_id", T.StringType()),
    T.StructField("event_ts", T.TimestampNTZType()),
])
