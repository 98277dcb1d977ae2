"""Portfolio jobs: stress grid (X2), by scenario or by dominance counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendflow import params as P
from lendflow.functions.metrics import amortised_repayment, dti_raw, expenses
from lendflow.sources.schemas import MONEY


def stress_grid(apps: DataFrame, scenarios, p=P.DEFAULT_POLICY) -> DataFrame:
    """Breach counts per scenario (id, serviceability buffer, DTI ceiling).

    One pass over the applications: the scenario-independent parts are staged as columns, the
    serviceability surplus is computed once per distinct buffer, every scenario's three flags are
    ``count_if`` columns of one global aggregate (partial on the map side), and only the small
    result is unpivoted.  No join, no row replication.  The arithmetic is the calculators' own
    (same operations in the same order), so flags equal P1-P3 under each scenario's policy."""
    buffers = sorted({b for _, b, _ in scenarios})
    d = lambda c: F.col(c).cast("double")
    x = apps.select(
        d("gross_annual_income").alias("_inc"), d("requested_loan_amount").alias("_loan"),
        d("existing_debts_monthly").alias("_debts"), d("base_interest_rate").alias("_base"),
        (expenses("declared_living_expenses", "cdr_verified_expenses_monthly", p)).alias("_exp"))
    x = x.select(
        "_inc", "_loan", "_debts", "_base",
        F.try_divide(F.col("_loan") + F.col("_debts") * F.lit(12.0) * F.lit(float(p.debt_years)),
                     F.col("_inc")).alias("_dti"),
        (F.col("_exp.status") == P.BREACH).alias("_e"),
        F.col("_exp.applicable_monthly_expense").cast(MONEY).cast("double").alias("_app"),
        (F.col("_inc") * F.lit(p.net_ratio) / F.lit(12.0)).alias("_net"))
    n = F.lit(float(p.months))
    rates = {b: (F.col("_base") + F.lit(b)) / F.lit(12.0) for b in buffers}
    x = x.select("_dti", "_e", "_app", "_net", "_debts", "_loan",
                 *[rates[b].alias(f"_r{i}") for i, b in enumerate(buffers)])
    x = x.select("_dti", "_e", "_app", "_net", "_debts", "_loan",
                 *[F.col(f"_r{i}") for i in range(len(buffers))],
                 *[F.pow(F.lit(1.0) + F.col(f"_r{i}"), n).alias(f"_g{i}") for i in range(len(buffers))])
    surplus = {}
    for i, b in enumerate(buffers):
        r, g = F.col(f"_r{i}"), F.col(f"_g{i}")
        repay = F.when(r == 0, F.try_divide(F.col("_loan"), n)).otherwise(
            F.try_divide(F.col("_loan") * (r * g), g - F.lit(1.0)))
        surplus[b] = (F.col("_net") - F.col("_app") - F.col("_debts") - repay) < 0
    x = x.select("_dti", "_e", *[surplus[b].alias(f"_s{i}") for i, b in enumerate(buffers)])
    aggs = [F.count(F.lit(1)).alias("n_apps"), F.count_if(F.col("_e")).alias("e_all")]
    for sid, b, lim in scenarios:
        dflag, sflag = F.col("_dti") >= F.lit(float(lim)), F.col(f"_s{buffers.index(b)}")
        aggs += [F.count_if(dflag).alias(f"d{sid}"), F.count_if(sflag).alias(f"s{sid}"),
                 F.count_if(dflag | F.col("_e") | sflag).alias(f"r{sid}")]
    tot = x.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(sid).alias("scenario_id"), F.lit(b).alias("buffer"),
                              F.lit(lim).alias("dti_limit"), F.col(f"d{sid}").alias("n_dti_breach"),
                              F.col("e_all").alias("n_expense_breach"), F.col(f"s{sid}").alias("n_serviceability_breach"),
                              F.col(f"r{sid}").alias("n_referred"), F.col("n_apps").alias("n_apps"))
                     for sid, b, lim in scenarios])
    out = tot.select(F.inline(rows))
    return out.withColumn("referral_rate", F.round(F.col("n_referred") / F.col("n_apps"), 4))


def _passed(values: list[float], fails) -> Column:
    """How many of ``values`` come before the first that ``fails`` (a function of a value; once true, true for all
    later ones): a binary search, one evaluation per halving."""
    table = F.array(*[F.lit(float(v)) for v in values])
    steps = [1 << i for i in reversed(range(len(values).bit_length()))]

    def walk(at: Column, step: Column) -> Column:
        ahead = at + step
        return F.when((ahead <= len(values)) & ~F.coalesce(fails(F.get(table, ahead - 1)), F.lit(False)), ahead).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), walk)


def stress_surface(apps: DataFrame, scenarios, p=P.DEFAULT_POLICY) -> DataFrame:
    """X2 for very many scenarios (id, serviceability buffer, DTI ceiling): the rows of ``stress_grid``.

    With a positive loan the surplus falls as the buffer rises, so an application is told by two places: the first of
    the sorted buffers it does not bear, and the number of ceilings it reaches.  Both are found by halving with the
    calculators' own arithmetic.  Applications are counted by place (at most buffers x ceilings cells, a partial
    aggregate), and a scenario's counts are sums of the cells on one side of it: running sums along both axes.  The
    work per application grows with the logarithm of the scenarios; all after the counts is bounded by their number.
    Applications must be valid ones (S4).  Unknown figures breach nothing, as in ``stress_grid``."""
    buffers, limits = sorted({float(b) for _, b, _ in scenarios}), sorted({float(x) for *_, x in scenarios})
    nb, nl = len(buffers), len(limits)
    d = lambda c: F.col(c).cast("double")
    spent = expenses("declared_living_expenses", "cdr_verified_expenses_monthly", p)
    x = apps.select(d("gross_annual_income").alias("_inc"), d("requested_loan_amount").alias("_loan"),
                    d("existing_debts_monthly").alias("_debts"), d("base_interest_rate").alias("_base"), spent.alias("_exp"))
    x = x.select("_loan", "_base", "_debts",
                 dti_raw("_inc", "_loan", "_debts", p).alias("_dti"),
                 F.coalesce(F.col("_exp.status") == P.BREACH, F.lit(False)).alias("_e"),
                 F.col("_exp.applicable_monthly_expense").cast(MONEY).cast("double").alias("_app"),
                 (F.col("_inc") * F.lit(p.net_ratio) / F.lit(12.0)).alias("_net"))

    def short(buffer: Column) -> Column:
        repay = amortised_repayment("_loan", F.col("_base") + buffer, F.lit(p.months))
        return (F.col("_net") - F.col("_app") - F.col("_debts") - repay) < 0

    reached = _passed(limits, lambda lim: F.coalesce(F.col("_dti"), F.lit(float("-inf"))) < lim)
    cells = (x.select(reached.alias("l"), _passed(buffers, short).alias("b"), "_e")
             .groupBy("l", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_e")).alias("clean")))
    grid = apps.sparkSession.range((nl + 1) * (nb + 1)).select(
        F.floor(F.col("id") / (nb + 1)).cast("int").alias("l"), (F.col("id") % (nb + 1)).cast("int").alias("b"))
    # At (l, b): the applications that reach at most l ceilings and bear at least b buffers.
    bear = Window.partitionBy("l").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    reach = Window.partitionBy("b").orderBy("l").rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.join(cells, ["l", "b"], "left").fillna(0, ["n", "clean"])
    for w in (bear, reach):
        sums = sums.select("l", "b", *[F.sum(c).over(w).alias(c) for c in ("n", "clean")])
    # Neither sum falls along an axis, so its largest value is the one at the axis' end.
    whole = Window.partitionBy(F.lit(0))
    sums = sums.select("l", "b", "clean", F.max("n").over(Window.partitionBy("l")).alias("below"),
                       F.max("n").over(Window.partitionBy("b")).alias("bearing"),
                       F.max("n").over(whole).alias("n_apps"), F.max("clean").over(whole).alias("all_clean"))
    place = [(sid, b, lim, limits.index(float(lim)), buffers.index(float(b)) + 1) for sid, b, lim in scenarios]
    asked = apps.sparkSession.createDataFrame(place, "scenario_id int, buffer double, dti_limit double, l int, b int")
    n = F.col("n_apps")
    return asked.join(sums, ["l", "b"]).select(
        "scenario_id", "buffer", "dti_limit", (n - F.col("below")).alias("n_dti_breach"),
        (n - F.col("all_clean")).alias("n_expense_breach"), (n - F.col("bearing")).alias("n_serviceability_breach"),
        (n - F.col("clean")).alias("n_referred"), n.alias("n_apps"),
        F.round(F.try_divide(n - F.col("clean"), n), 4).alias("referral_rate"))
