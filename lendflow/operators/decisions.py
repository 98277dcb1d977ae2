"""Human decisions: label, validation and the pending gate.

Decisions arrive as a DataFrame (never spliced into SQL text).  A decision is accepted when its
stripped notes hold at least ``MIN_NOTE_CHARS`` characters, its value is one the console can send,
and the application's newest ledger row *before the decision* is PENDING_REVIEW: the row the
reviewer saw.  Once one decision lands the file is no longer pending, so among several valid
decisions on one pending row the earliest wins and the rest find it already decided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendflow import params as P
from lendflow.functions.text import py_strip


def action_label(col="decision") -> F.Column:
    """APPROVED_OVERRIDE -> APPROVE, anything else -> DECLINE."""
    return F.when(F.col(col) == P.APPROVED_OVERRIDE, F.lit("APPROVE")).otherwise(F.lit("DECLINE"))


def validate(decisions: DataFrame) -> DataFrame:
    """``clean_notes`` = stripped notes; ``notes_valid`` when at least 10 characters."""
    clean = py_strip("notes")
    return decisions.withColumns({
        "action": action_label(),
        "clean_notes": clean,
        "notes_valid": F.coalesce(F.length(clean) >= P.MIN_NOTE_CHARS, F.lit(False)),
    })


def as_of(decisions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each decision with the newest ledger row before it: ``seen_event_id`` and ``seen_decision``
    (null when the application has no earlier row).  Order is (time, id).

    An application's history is cut by day, so a hot application spreads over as many tasks as it has
    days: a day's closing row (partial aggregate) is carried to the days after it, and only the
    rows of one day are put in order together."""
    rows = ledger.select("application_id", F.col("timestamp").alias("_t"), F.col("event_id").alias("_i"),
                         F.struct("event_id", "underwriter_decision").alias("_row"))
    asked = decisions.select("application_id", F.col("event_ts").alias("_t"), F.col("decision_id").alias("_i"),
                             F.struct(*decisions.columns).alias("_ask"))
    day = F.to_date("_t")
    closing = rows.groupBy("application_id", day.alias("_day")).agg(
        F.max_by("_row", F.struct("_t", "_i")).alias("_close"))
    days = closing.unionByName(asked.select("application_id", day.alias("_day")), allowMissingColumns=True)
    days = days.groupBy("application_id", "_day").agg(F.first("_close", ignorenulls=True).alias("_close"))
    earlier = Window.partitionBy("application_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("application_id", "_day", F.last("_close", ignorenulls=True).over(earlier).alias("_carry"))
    # A ledger row with the decision's own time and id comes after it.
    both = rows.withColumn("_kind", F.lit(1)).unionByName(asked.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    within = (Window.partitionBy("application_id", "_day").orderBy("_t", "_i", "_kind")
              .rowsBetween(Window.unboundedPreceding, -1))
    seen = (both.withColumn("_day", day).withColumn("_same", F.last("_row", ignorenulls=True).over(within))
            .filter("_kind = 0").join(carried, ["application_id", "_day"], "left")
            .withColumn("_seen", F.coalesce("_same", "_carry")))
    return seen.select("_ask.*", F.col("_seen.event_id").alias("seen_event_id"),
                       F.col("_seen.underwriter_decision").alias("seen_decision"))


def judged(decisions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every decision with a ``reject_reason`` (null when it passes): notes_too_short,
    unknown_decision, not_pending.  One pass over both inputs."""
    v = as_of(validate(decisions), ledger)
    pending = F.coalesce(F.col("seen_decision") == P.PENDING_REVIEW, F.lit(False))
    known = F.coalesce(F.col("decision").isin(*P.DECISION_DOMAIN), F.lit(False))
    return v.withColumn("reject_reason", F.when(~F.col("notes_valid"), "notes_too_short")
                        .when(~known, "unknown_decision").when(~pending, "not_pending"))


def gate(decisions: DataFrame, ledger: DataFrame):
    """(passed, rejected): the two halves of ``judged``."""
    j = judged(decisions, ledger)
    return (j.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            j.filter(F.col("reject_reason").isNotNull()))


def accepted(decisions: DataFrame, ledger: DataFrame) -> DataFrame:
    """The decisions that land: for each pending row the earliest passed one (event time, then id).
    ``min_by`` aggregates partially, so a burst of decisions on one file is pre-reduced."""
    passed, _ = gate(decisions, ledger)
    keys = ("application_id", "seen_event_id")
    cols = [c for c in passed.columns if c not in keys]
    first = passed.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct("event_ts", "decision_id")).alias("_d"))
    return first.select(*keys, "_d.*")
