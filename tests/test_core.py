"""Persona goldens, boundary rows and properties of the deterministic core."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import PERSONAS, write_payloads
from lendflow import params as P
from lendflow.functions.metrics import amortised_repayment, flat_metrics, register_sql_functions, with_metrics
from lendflow.functions.text import fmt_calc, fmt_in, py_strip
from lendflow.operators import ledger, policy, privacy
from lendflow.sources.payloads import quarantine, read_applications, with_notes_default
from lendflow.sources.schemas import APP_SCHEMA

GOLDEN = {  # FIXTURES.md §1: recomputed, not the readme's table
    "APP-101": (3.64, "PASS", "2500.00", "-50.00", "PASS", 4979.59, 2145.41, "PASS"),
    "APP-102": (6.71, "BREACH", "2420.00", "50.00", "PASS", 7054.42, -2807.76, "BREACH"),
    "APP-103": (4.67, "PASS", "3450.00", "1850.00", "BREACH", 5809.52, -509.52, "BREACH"),
    "APP-104": (7.66, "BREACH", "2500.00", "100.00", "PASS", 5643.54, -3401.87, "BREACH"),
}
BREACHES = {
    "APP-101": [],
    "APP-102": ["DTI Breach: 6.71x (Ceiling: 6.0x)",
                "Net Serviceability Deficit: Stressed surplus is -$2807.76/mo at stressed rate of 9.35%"],
    "APP-103": ["Living Expense Discrepancy: Declared $1600 vs Actual $3450",
                "Net Serviceability Deficit: Stressed surplus is -$509.52/mo at stressed rate of 9.35%"],
    "APP-104": ["DTI Breach: 7.66x (Ceiling: 6.0x)",
                "Net Serviceability Deficit: Stressed surplus is -$3401.87/mo at stressed rate of 9.35%"],
}


def _apps(spark, rows):
    full = [{**{f.name: None for f in APP_SCHEMA.fields}, **r} for r in rows]
    conv = []
    for r in full:
        conv.append(tuple(
            (Decimal(str(r[f.name])) if r[f.name] is not None and f.dataType.typeName() == "decimal" else r[f.name])
            for f in APP_SCHEMA.fields))
    return spark.createDataFrame(conv, APP_SCHEMA)


def test_read_payloads_needs_schema_and_multiline(spark, persona_dir):
    df = read_applications(spark, persona_dir)
    assert df.count() == 4
    bad = df.filter(F.col("_corrupt_record").isNotNull()).select("application_id", "_corrupt_record").collect()
    assert bad == []
    assert dict(df.dtypes)["gross_annual_income"] == "decimal(18,2)"


def test_persona_metrics(spark, persona_dir):
    m = flat_metrics(with_metrics(read_applications(spark, persona_dir))).collect()
    assert len(m) == 4
    for r in m:
        g = GOLDEN[r.application_id]
        got = (r.calculated_dti, r.dti_status, str(r.applicable_monthly_expense), str(r.expense_discrepancy),
               r.expense_status, r.stressed_monthly_repayment, r.net_monthly_surplus, r.serviceability_status)
        assert got == g, r.application_id
        assert r.stressed_interest_rate == 0.0935


def test_persona_breaches_and_recommendation(spark, persona_dir):
    a = policy.assess(read_applications(spark, persona_dir)).collect()
    for r in a:
        assert list(r.policy_breaches) == BREACHES[r.application_id]
        assert r.system_recommendation == ("AUTO_APPROVE" if not BREACHES[r.application_id] else "ESCALATED_REFERRAL")
        # property: breach list empty <=> AUTO_APPROVE; codes parallel the messages
        assert len(r.breach_codes) == len(r.policy_breaches)


def test_audit_rows_personas(spark, persona_dir):
    apps = privacy.mask_applications(with_notes_default(read_applications(spark, persona_dir).drop("_corrupt_record")))
    rows = ledger.audit_rows(policy.with_outcome(policy.assess(apps)), dt.datetime(2024, 1, 1)).collect()
    by = {r.application_id: r for r in rows}
    r = by["APP-101"]
    assert (r.policy_breaches, r.underwriter_id, r.underwriter_decision, r.underwriter_notes) == (
        "NONE", "SYSTEM_AUTO_EXECUTION", "AUTO_APPROVED", "All ratios within mandated thresholds.")
    r = by["APP-102"]
    assert r.policy_breaches == "; ".join(BREACHES["APP-102"])
    assert (r.underwriter_id, r.underwriter_decision, r.underwriter_notes) == ("PENDING_REVIEW", "PENDING_REVIEW", "N/A")
    assert all(x.applicant_name == "<PERSON>" for x in rows)
    assert r.calculated_dti == 6.71 and r.net_monthly_surplus == -2807.76


def test_union_form_equals_when_form(spark, persona_dir):
    a = policy.assess(read_applications(spark, persona_dir).drop("_corrupt_record"))
    cols = ["application_id", "ai_risk_memo", "underwriter_id", "underwriter_decision", "underwriter_notes"]
    u = sorted(map(tuple, policy.union_outcome(a).select(*cols).collect()))
    w = sorted(map(tuple, policy.with_outcome(a).select(*cols).collect()))
    assert u == w
    memo = [x for x in w if x[0] == "APP-101"][0][1]
    assert memo == "Application APP-101 meets all APRA and ASIC credit policies. Clean auto-approval granted."


@pytest.mark.parametrize("income,loan,expected_dti,status", [
    (100000, 600000, 6.0, "BREACH"),   # >= on the unrounded value
    (100000, 599600, 6.0, "PASS"),     # 5.996 shows 6.0 yet passes
])
def test_dti_boundary(spark, income, loan, expected_dti, status):
    df = _apps(spark, [dict(application_id="B", applicant_name="x", gross_annual_income=income,
                            declared_living_expenses=1000, requested_loan_amount=loan, base_interest_rate=0.05,
                            existing_debts_monthly=0, cdr_verified_expenses_monthly=1000)])
    r = flat_metrics(with_metrics(df)).first()
    assert (r.calculated_dti, r.dti_status) == (expected_dti, status)


@pytest.mark.parametrize("declared,verified,applicable,delta,status", [
    ("1000", "1500", "2420.00", "500.00", "PASS"),
    ("1000", "1500.01", "2420.00", "500.01", "BREACH"),
    ("5000", "1000", "5000.00", "-4000.00", "PASS"),   # one-sided
    ("2000", "2100", "2420.00", "100.00", "PASS"),     # HEM floor binds
])
def test_expense_boundary(spark, declared, verified, applicable, delta, status):
    df = _apps(spark, [dict(application_id="B", applicant_name="x", gross_annual_income=100000,
                            declared_living_expenses=declared, requested_loan_amount=100000, base_interest_rate=0.05,
                            existing_debts_monthly=0, cdr_verified_expenses_monthly=verified)])
    r = flat_metrics(with_metrics(df)).first()
    assert (str(r.applicable_monthly_expense), str(r.expense_discrepancy), r.expense_status) == (applicable, delta, status)


def test_amortised_repayment_goldens(spark):
    df = spark.createDataFrame([(100000.0, 0.06), (500000.0, 0.085), (1000000.0, 0.12), (36000.0, 0.0)], "p double, r double")
    got = [x[0] for x in df.select(F.round(amortised_repayment("p", "r", 360), 2)).collect()]
    assert got == [599.55, 3844.57, 10286.13, 100.0]


def test_repayment_rises_with_rate(spark):
    df = spark.range(1, 200).select((F.col("id") / 1000.0).alias("r"))
    vals = [x[0] for x in df.orderBy("r").select(amortised_repayment(F.lit(300000.0), "r", 360)).collect()]
    assert all(a < b for a, b in zip(vals, vals[1:]))


def test_surplus_zero_is_pass(spark):
    e = F.when(F.lit(0.0) < 0, "BREACH").otherwise("PASS")
    assert spark.range(1).select(e).first()[0] == "PASS"


def test_number_echo(spark):
    df = spark.createDataFrame([(Decimal("1600"), 6.0), (Decimal("1600.5"), 6.5), (Decimal("0"), 6.71),
                                (Decimal("12500000"), 12500000.0)], "a decimal(18,2), b double")
    got = df.select(fmt_in("a"), fmt_calc("b")).collect()
    assert [tuple(r) for r in got] == [("1600", "6.0"), ("1600.5", "6.5"), ("0", "6.71"), ("12500000", "12500000.0")]


def test_quarantine_split(spark):
    rows = [dict(application_id="OK", applicant_name="a", gross_annual_income=1, declared_living_expenses=0,
                 requested_loan_amount=1, base_interest_rate=0.05, existing_debts_monthly=0,
                 cdr_verified_expenses_monthly=0),
            dict(application_id="ZERO", applicant_name="a", gross_annual_income=0, declared_living_expenses=0,
                 requested_loan_amount=1, base_interest_rate=0.05, existing_debts_monthly=0,
                 cdr_verified_expenses_monthly=0),
            dict(application_id="NULL", applicant_name="a", gross_annual_income=None, declared_living_expenses=0,
                 requested_loan_amount=1, base_interest_rate=0.05, existing_debts_monthly=0,
                 cdr_verified_expenses_monthly=0),
            dict(application_id="RATE", applicant_name="a", gross_annual_income=1, declared_living_expenses=0,
                 requested_loan_amount=1, base_interest_rate=-0.03, existing_debts_monthly=0,
                 cdr_verified_expenses_monthly=0)]
    df = _apps(spark, rows)
    valid, rejected = quarantine(df)
    assert [r.application_id for r in valid.collect()] == ["OK"]
    reasons = {r.application_id: list(r.reject_reasons) for r in rejected.collect()}
    assert reasons == {"ZERO": ["non_positive_income"], "NULL": ["missing:gross_annual_income"],
                       "RATE": ["zero_stressed_rate"]}
    assert valid.count() + rejected.count() == df.count()


def test_malformed_payload_quarantined(spark, tmp_path):
    d = write_payloads(tmp_path / "raw", PERSONAS[:1])
    (tmp_path / "raw" / "BAD.json").write_text("{ not json")
    valid, rejected = quarantine(read_applications(spark, d))
    assert valid.count() == 1
    assert rejected.first().reject_reasons[0] == "malformed_json"


def test_notes_default(spark, persona_dir):
    r = with_notes_default(read_applications(spark, persona_dir)).select("applicant_notes").distinct().collect()
    assert [x[0] for x in r] == [P.DEFAULT_NOTES]


def test_mask_name_cases(spark):
    df = spark.createDataFrame([(None,), ("   ",), ("J. Smith",), ("Sarah Jenkins",)], "n string")
    assert [r[0] for r in df.select(privacy.mask_name("n")).collect()] == [
        "[REDACTED_PERSON]", "[REDACTED_PERSON]", "<PERSON>", "<PERSON>"]


def test_mask_text_never_leaks(spark):
    df = spark.createDataFrame([("Call J. Smith at +1 (555) 555-1234 or j.smith@x.example.com, card 4111 1111 1111 1111",
                                 "J. Smith")], "t string, n string")
    out = df.select(privacy.mask_text("t", "n")).first()[0]
    assert out == "Call <PERSON> at <PHONE> or <EMAIL>, card <CARD>"


def test_py_strip_matches_python(spark):
    s = "  pad\t "
    assert spark.range(1).select(py_strip(F.lit(s))).first()[0] == s.strip()


def test_sql_functions_inline(spark):
    register_sql_functions(spark)
    r = spark.sql("SELECT dti_of(100000D, 600000D, 0D) AS d, dti_status_of(100000D, 599600D, 0D) AS s, "
                  "round(repayment_of(100000D, 0.06D, 360), 2) AS r").first()
    assert (r.d, r.s, r.r) == (6.0, "PASS", 599.55)


def test_declared_table_schemas_match_files(spark):
    from lendflow.sources.tables import TABLE_SCHEMAS, TABLES, table_path
    from pyspark.sql.types import _parse_datatype_string
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        for t in TABLES:
            inferred = spark.read.parquet(table_path(sf, t)).schema
            declared = _parse_datatype_string(TABLE_SCHEMAS[t])
            assert [(f.name, f.dataType) for f in inferred] == [(f.name, f.dataType) for f in declared], (sf, t)


def test_exact_cents_equals_decimal_cast(spark):
    from lendflow.functions.metrics import exact_cents
    vals = [1.005, 2.675, 0.125, 1e13 + 0.01, 123456.78, -4.335, 0.0, 1.0000000001, 99.995, 7.1e-7, 5e14 + 0.5,
            9999999.99, 10000000.01, 0.1 + 0.2, 3.3 * 3, 1234567.895]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(exact_cents("x").alias("a"), (F.col("x").cast("decimal(18,2)") * 100).cast("long").alias("b")).collect()
    assert all(r.a == r.b for r in got), [(v, r.a, r.b) for v, r in zip(vals, got)]


def test_masking_holds_for_local_phones_and_name_variants(spark):
    from lendflow.operators import privacy
    rows = [
        ("alex chen called on 0412 345 678; Alex prefers (02) 9999 1234", "Alex Chen",
         "<PERSON> called on <PHONE>; <PERSON> prefers <PHONE>"),
        ("CHEN: 1300 123 456, 13 12 34, +61 412 345 678, +61 2 9999 1234 and (123) 456-7890", "Alex Chen",
         "<PERSON>: <PHONE>, <PHONE>, <PHONE>, <PHONE> and <PHONE>"),
        ("cards 1234 5678 9012 3456 1234-5678-9012-3456 but not 12345678901234567890", "Al",
         "cards <CARD> <CARD> but not 12345678901234567890"),
        ("write to alex.chen@mail.example.com; Alexander is someone else", "Alex Chen",
         "write to <EMAIL>; Alexander is someone else"),
        ("a (b) [c] $1 a", "a (b)", "<PERSON> [c] $1 a"),
        ("nobody", None, "nobody"), (None, "Alex", None),
    ]
    df = spark.createDataFrame([(t, n) for t, n, _ in rows], "t string, n string")
    got = [r.m for r in df.select(privacy.mask_text("t", "n").alias("m")).collect()]
    assert got == [w for _, _, w in rows]


def test_audit_sees_what_masking_patterns_do_not_know(spark):
    from lendflow.operators import privacy
    rows = spark.createDataFrame([("A", "call 99 88 77 66 please"), ("B", "mrs chen rang"), ("C", "x@y"), ("D", "fine 123")],
                                 "application_id string, notes string")
    names = spark.createDataFrame([("B", "Wei Chen")], "application_id string, real_name string")
    got = {r.leak_kind: r.n_rows for r in privacy.leak_audit(rows, names, ["notes"]).collect()}
    assert got == {"EMAIL": 1, "CARD": 0, "PHONE": 1, "NAME": 1, "OTHER_NAME": 0}
