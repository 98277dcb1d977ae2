"""Console queries over the ledger's latest state (A1, F2, Z3 batch form) and breach mix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendflow import params as P

APPROVED_EXACT = (P.APPROVED_OVERRIDE, P.AUTO_APPROVED)


def counts(latest_rows: DataFrame) -> DataFrame:
    """A1: total, pending, approved (the two exact values only), declined in one pass."""
    d = F.col("underwriter_decision")
    return latest_rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(d == P.PENDING_REVIEW).alias("pending"),
        F.count_if(d.isin(*APPROVED_EXACT)).alias("approved"),
        F.count_if(d == P.DECLINED).alias("declined"),
    )


def counts_of(groups: DataFrame) -> DataFrame:
    """A1 from counts by decision (underwriter_decision, n): the same row as ``counts``."""
    d, none = F.col("underwriter_decision"), F.lit(0).cast("long")

    def of(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), none)

    return groups.agg(of(F.lit(True)).alias("total"), of(d == P.PENDING_REVIEW).alias("pending"),
                      of(d.isin(*APPROVED_EXACT)).alias("approved"), of(d == P.DECLINED).alias("declined"))


def queue(latest_rows: DataFrame, which: str = "ALL") -> DataFrame:
    """ALL, PENDING (= PENDING_REVIEW), APPROVED (contains "APPROVED"), DECLINED.
    A null decision matches no filter but ALL."""
    d = F.col("underwriter_decision")
    cond = {
        "ALL": None,
        "PENDING": d == P.PENDING_REVIEW,
        "APPROVED": d.contains("APPROVED"),
        "DECLINED": d == P.DECLINED,
    }[which]
    rows = latest_rows if cond is None else latest_rows.filter(cond)
    return rows.select("application_id", "system_recommendation", "underwriter_decision")


def decisions_per_window(ledger: DataFrame, width: str = "1 day") -> DataFrame:
    """Z3 (batch form): decision counts per tumbling time window."""
    return (ledger.groupBy(F.window("timestamp", width).alias("w"), "underwriter_decision")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "underwriter_decision", "n"))


def breach_mix(assessed: DataFrame) -> DataFrame:
    """Breach codes by segment with rollup subtotals.

    Aggregate first: one ``count_if`` per code and segment (partial on the map side), so no
    application row is exploded or expanded; the rollup then runs over at most
    segments x codes rows."""
    per = assessed.groupBy("segment").agg(
        *[F.count_if(F.array_contains("breach_codes", c)).alias(c) for c in P.BREACH_CODES])
    cells = per.select("segment", F.inline(F.array(*[
        F.struct(F.lit(c).alias("breach_code"), F.col(c).alias("n")) for c in P.BREACH_CODES])))
    cells = cells.filter(F.col("n") > 0)
    return cells.rollup("segment", "breach_code").agg(F.sum("n").cast("long").alias("n"))
