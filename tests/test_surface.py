"""Dominance counting gives the rows of the scenario-by-scenario grid."""

from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF01
from lendflow.operators import portfolio
from lendflow.sources import derived as D
from lendflow.sources.schemas import APP_SCHEMA


def _rows(df):
    return sorted(map(tuple, df.select("scenario_id", "buffer", "dti_limit", "n_dti_breach", "n_expense_breach",
                                       "n_serviceability_breach", "n_referred", "n_apps", "referral_rate").collect()))


def test_surface_equals_grid(spark):
    apps = D.applications(spark, SF01).withColumn("declared_living_expenses", F.when(
        F.col("application_id").like("%7"), F.col("declared_living_expenses")))          # some unknown figures
    scenarios = [(1, 0.03, 6.0), (2, -0.01, 1.5), (3, 0.0, 7.25), (4, 0.2, 100.0), (5, 0.031, 0.0), (6, 0.03, 7.25),
                 (7, 0.03, 6.0)]                                                          # no full grid; one twice
    assert _rows(portfolio.stress_surface(apps, scenarios)) == _rows(portfolio.stress_grid(apps, scenarios))


def test_surface_at_the_edges(spark):
    """A zero stressed rate, a ratio equal to the ceiling, no applications, one scenario."""
    row = ("A", "n", Decimal(100000), Decimal(1000), Decimal(600000), Decimal(1), Decimal("0.05"), Decimal(0), Decimal(1000), None)
    one = spark.createDataFrame([row, row], APP_SCHEMA)
    scenarios = [(1, -0.05, 6.0), (2, 0.0, 6.0000001), (3, 0.9, 5.0)]
    assert _rows(portfolio.stress_surface(one, scenarios)) == _rows(portfolio.stress_grid(one, scenarios))
    assert _rows(portfolio.stress_surface(one, scenarios[:1]))[0][3] == 2
    empty = _rows(portfolio.stress_surface(one.limit(0), scenarios))
    assert [r[3:8] for r in empty] == [(0,) * 5] * 3 and {r[8] for r in empty} == {None}
