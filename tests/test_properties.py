"""Property tests: random applications against a plain-Python statement of the formulas."""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendflow.functions.metrics import flat_metrics
from lendflow.operators import policy
from lendflow.sources.payloads import quarantine
from lendflow.sources.schemas import APP_SCHEMA

money = st.integers(min_value=0, max_value=2_000_000_00).map(lambda c: Decimal(c) / 100)
rate = st.integers(min_value=-40_000, max_value=150_000).map(lambda r: Decimal(r) / 1_000_000)
app = st.tuples(money, money, money, money, rate, money, money)


def expected(income, declared, loan, debts, verified, base):
    """The three calculators restated in Python floats (statuses on unrounded values)."""
    i, d, l, e, v, b = map(float, (income, declared, loan, debts, verified, base))
    dti = (l + e * 12 * 5) / i
    applicable = max(declared, verified, Decimal(2420))
    delta = verified - declared
    r = (b + 0.03) / 12
    repay = l / 360 if r == 0 else l * (r * (1 + r) ** 360) / ((1 + r) ** 360 - 1)
    surplus = (i * 0.70) / 12 - float(applicable) - e - repay
    return dict(dti_status="BREACH" if dti >= 6.0 else "PASS", calculated_dti=dti,
                applicable_monthly_expense=applicable, expense_discrepancy=delta,
                expense_status="BREACH" if delta > 500 else "PASS",
                stressed_monthly_repayment=repay, net_monthly_surplus=surplus,
                serviceability_status="BREACH" if surplus < 0 else "PASS")


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(app, min_size=40, max_size=40))
def test_metrics_match_formulas_and_partitions_hold(spark, rows):
    data = [(f"A{i}", "x", inc, dec, loan, None, base, debts, ver, None)
            for i, (inc, dec, loan, debts, base, ver, _) in enumerate(rows)]
    df = spark.createDataFrame(data, APP_SCHEMA)
    valid, rejected = quarantine(df)
    n_valid, n_rej = valid.count(), rejected.count()
    assert n_valid + n_rej == len(data)
    a = policy.assess(valid)
    got = {r.application_id: r for r in flat_metrics(a).collect()}
    by_id = {d[0]: d for d in data}
    for aid, r in got.items():
        _, _, inc, dec, loan, _, base, debts, ver, _ = by_id[aid]
        e = expected(inc, dec, loan, debts, ver, base)
        assert r.dti_status == e["dti_status"]
        assert r.expense_status == e["expense_status"]
        assert r.serviceability_status == e["serviceability_status"]
        assert abs(r.calculated_dti - e["calculated_dti"]) <= 0.005 + 1e-9 * abs(e["calculated_dti"])
        assert r.applicable_monthly_expense == e["applicable_monthly_expense"]
        assert r.expense_discrepancy == e["expense_discrepancy"]
        assert abs(r.stressed_monthly_repayment - e["stressed_monthly_repayment"]) <= 0.005 + 1e-9 * abs(e["stressed_monthly_repayment"])
        assert abs(r.net_monthly_surplus - e["net_monthly_surplus"]) <= 0.005 + 1e-9 * abs(e["net_monthly_surplus"])
        assert (len(r.policy_breaches) == 0) == (r.system_recommendation == "AUTO_APPROVE")
    clean, breached = policy.route(a)
    assert clean.count() + breached.count() == n_valid
    assert clean.filter(F.size("policy_breaches") > 0).count() == 0


def test_exact_cents_random_amounts(spark):
    import numpy as np
    from lendflow.functions.metrics import exact_cents
    rng = np.random.default_rng(11)
    mags = 10.0 ** rng.integers(-3, 16, size=200_000)
    raw = rng.uniform(-1, 1, size=200_000) * mags
    vals = [round(float(v), int(d)) for v, d in zip(raw, rng.integers(0, 5, size=200_000))]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").filter("abs(x) < 1e15")
    bad = df.filter(exact_cents("x") != (F.col("x").cast("decimal(18,2)") * 100).cast("long")).count()
    assert bad == 0
