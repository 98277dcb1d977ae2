"""Append-only audit ledger: projection, write, latest state, updates and resets.

The reference keeps a mutable table and UPDATEs rows in place.  Here the ledger is an
append-only, ``dt``-partitioned Parquet table of events (SYSTEM / HUMAN / RESET); the current
state of an application is its latest row (W1 / A2).  The in-place forms of the reference's
UPDATEs (K3a, K4a) are also provided as functional rewrites of the whole table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendflow import params as P
from lendflow.session import materialize, numbered, path_exists
from lendflow.sources.schemas import LEDGER_COLUMNS, LEDGER_SCHEMA

LEDGER_NAMES = tuple(LEDGER_SCHEMA.names)
FILE_SCHEMA = T.StructType([*LEDGER_SCHEMA.fields, T.StructField("batch", T.LongType())])
ORDER_KEY = ("timestamp", "event_id")  # newest first: timestamp, then event id as tie-break


def wall_clock(ts: dt.datetime) -> Column:
    """A naive datetime as a ``timestamp_ntz`` literal, independent of any time zone setting
    (a datetime literal would be read in the Python process's zone, then shifted by the cast)."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def newest_first() -> list[Column]:
    return [F.col(c).desc() for c in ORDER_KEY]


# --- K2: projection and append -------------------------------------------------------------------
def breaches_text(col="policy_breaches") -> Column:
    """A3: breaches joined by "; ", or NONE when there are none (concat_ws of [] is '')."""
    return F.when(F.size(col) > 0, F.array_join(col, P.BREACH_SEPARATOR)).otherwise(F.lit(P.NO_BREACHES))


def audit_rows(outcome: DataFrame, run_ts: dt.datetime | Column, event_id: Column | None = None) -> DataFrame:
    """K2: one ledger row per assessed application.  Decision fields default to
    PENDING_REVIEW / PENDING_REVIEW / N/A; the timestamp is one value for the whole run."""
    ts = run_ts if isinstance(run_ts, Column) else wall_clock(run_ts)
    return outcome.select(
        (event_id if event_id is not None else F.lit(None).cast("long")).alias("event_id"),
        F.lit("SYSTEM").alias("event_type"),
        "application_id",
        "applicant_name",
        "system_recommendation",
        F.col("dti_result.calculated_dti").alias("calculated_dti"),
        F.col("serviceability_result.net_monthly_surplus").alias("net_monthly_surplus"),
        breaches_text().alias("policy_breaches"),
        F.coalesce("underwriter_id", F.lit(P.PENDING_REVIEW)).alias("underwriter_id"),
        F.coalesce("underwriter_decision", F.lit(P.PENDING_REVIEW)).alias("underwriter_decision"),
        F.coalesce("underwriter_notes", F.lit(P.NOT_AVAILABLE)).alias("underwriter_notes"),
        ts.alias("timestamp"),
        F.to_date(ts).alias("dt"),
    )


RUN_EVENTS = 1 << 32                  # event ids of one run or micro-batch


def run_base(run: int | Column) -> Column:
    """First event id of a run (or micro-batch): runs own ``RUN_EVENTS`` consecutive ids each."""
    return (run if isinstance(run, Column) else F.lit(run)).cast("long") * F.lit(RUN_EVENTS)


def ensure_ledger(spark: SparkSession, path: str) -> DataFrame:
    """K1: create the ledger if it does not exist (an empty Parquet table partitioned by run and day)."""
    if not path_exists(spark, path):
        empty = spark.createDataFrame([], LEDGER_SCHEMA).withColumn("batch", F.lit(0).cast("long"))
        empty.write.mode("append").partitionBy("batch", "dt").parquet(path)
    return read_ledger(spark, path)


def create_table(spark: SparkSession, path: str, name: str = "audit_trail") -> DataFrame:
    """K1 in SQL form: a catalog table over the ledger folder, so console SQL runs as written
    (``SELECT ... FROM audit_trail ORDER BY timestamp DESC``).  Idempotent; call it again after
    ``append`` to register new partitions (partition recovery lists the folder)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LEDGER_SCHEMA.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}, batch BIGINT) USING parquet PARTITIONED BY (batch, dt) "
              f"LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    spark.sql(f"REFRESH TABLE {name}")
    return spark.table(name)


def _ledger_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return _ledger_files(spark, path).select(*LEDGER_NAMES)


def write_run(rows: DataFrame, path: str, run: int) -> None:
    """The rows of one run under ``batch=<run>/dt=...``.  A retry overwrites the run's own
    folder and nothing else, so no row is ever appended twice."""
    (rows.select(*LEDGER_NAMES).write.mode("overwrite").partitionBy("dt")
     .parquet(f"{path.rstrip('/')}/batch={run}"))


def append(rows: DataFrame, path: str, run: int) -> DataFrame:
    """Number the rows and write them as one run."""
    write_run(numbered(rows.drop("event_id"), run_base(run)), path, run)
    return read_ledger(rows.sparkSession, path)


def compact(spark: SparkSession, path: str, day: dt.date, before: int, files: int = 8) -> None:
    """Rewrite one day of all runs below ``before`` into ``files`` files of the newest of these runs
    (streaming appends leave many small files).

    Runs from ``before`` on are not touched, so a stream may go on writing.  The rows are first
    written as a table in the shared folder and the small files are deleted last; event ids are
    unique, so a rewrite that died in between is mended by running it again."""
    root = path.rstrip("/")
    part = _ledger_files(spark, root).filter((F.col("dt") == F.lit(day)) & (F.col("batch") < before))
    runs = sorted(r[0] for r in part.select("batch").distinct().collect())         # one row per run
    if len(runs) < 2:
        return
    staged = materialize(part.drop("batch").dropDuplicates(["event_id"]), f"ledger-dt={day.isoformat()}")
    target = runs[-1]
    (staged.drop("dt").repartition(files).write.mode("overwrite")
     .parquet(f"{root}/batch={target}/dt={day.isoformat()}"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for run in runs[:-1]:
        old = hadoop(f"{root}/batch={run}/dt={day.isoformat()}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


# --- W1 / A2 / S9 / S10 / T1 ---------------------------------------------------------------------
def latest(ledger: DataFrame) -> DataFrame:
    """Newest row per application.  ``row_number() = 1`` lets Spark add a partial
    WindowGroupLimit before the shuffle, so a hot application ships one row per map task."""
    w = Window.partitionBy("application_id").orderBy(*newest_first())
    return ledger.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_agg(ledger: DataFrame) -> DataFrame:
    """A2: the same rows by aggregation: ``max_by(row, (timestamp, event_id))`` combines
    partially on the map side, so a hot application ships one row per map task.  The kept row
    holds strings, so Spark runs it as a sort-based aggregate (each map partition is sorted by
    application; the window form sorts as well)."""
    cols = [c for c in ledger.columns if c != "application_id"]
    agg = ledger.groupBy("application_id").agg(
        F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in ORDER_KEY])).alias("_row"))
    return agg.select("application_id", "_row.*").select(*ledger.columns)


def dashboard_scan(ledger: DataFrame, *more: str) -> DataFrame:
    """The console's columns (Catalyst prunes the scan to them)."""
    return ledger.select("application_id", "system_recommendation", "underwriter_decision", "timestamp", *more)


def point(ledger: DataFrame, application_id: str) -> DataFrame:
    """S10 + T1: newest row of one application (filter pushed to the scan, TakeOrderedAndProject)."""
    return ledger.filter(F.col("application_id") == application_id).orderBy(*newest_first()).limit(1)


def newest_overall(ledger: DataFrame) -> DataFrame:
    """The newest row of the whole ledger."""
    return ledger.orderBy(*newest_first()).limit(1)


# --- W2 ------------------------------------------------------------------------------------------
HUMAN_DECISIONS = (P.APPROVED_OVERRIDE, P.DECLINED)


def hidden_decisions(ledger: DataFrame) -> DataFrame:
    """Applications whose latest row is PENDING_REVIEW directly after a human decision
    (a system re-run hid it).  One scan and one shuffle: ``row_number() <= 2`` becomes a partial
    WindowGroupLimit, so at most two rows of an application leave a map task."""
    w = Window.partitionBy("application_id").orderBy(*newest_first())
    two = (ledger.select("application_id", "event_id", "timestamp", "underwriter_decision")
           .withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2"))
    pair = two.groupBy("application_id").agg(
        F.min_by(F.struct("event_id", "timestamp", "underwriter_decision"), "_rn").alias("_l"),
        F.max(F.when(F.col("_rn") == 2, F.col("underwriter_decision"))).alias("hidden_decision"))
    return pair.filter((F.col("_l.underwriter_decision") == P.PENDING_REVIEW)
                       & F.col("hidden_decision").isin(*HUMAN_DECISIONS)).select(
        "application_id", "_l.event_id", "_l.timestamp", F.col("_l.underwriter_decision").alias("latest_decision"),
        "hidden_decision")


# --- K3 / J5: human decisions --------------------------------------------------------------------
def update_in_place(ledger: DataFrame, accepted: DataFrame) -> DataFrame:
    """K3(a) / J5: the reference's UPDATE as a join: every row an application has when it is decided
    takes the decision, notes and underwriter id; timestamps are unchanged, and rows appended
    later keep their own.  Of several decisions of one application the newest was written last."""
    newest = accepted.groupBy("application_id").agg(F.max(
        F.struct("event_ts", "decision_id", "decision", "clean_notes", "underwriter_id")).alias("_d"))
    j = ledger.join(newest, "application_id", "left")   # derived side: AQE sizes it at runtime
    there = F.struct("timestamp", "event_id") < F.struct("_d.event_ts", "_d.decision_id")
    decided = F.coalesce(there, F.lit(False))
    return j.withColumns({
        "underwriter_decision": F.when(decided, F.col("_d.decision")).otherwise(F.col("underwriter_decision")),
        "underwriter_notes": F.when(decided, F.col("_d.clean_notes")).otherwise(F.col("underwriter_notes")),
        "underwriter_id": F.when(decided, F.col("_d.underwriter_id")).otherwise(F.col("underwriter_id")),
    }).drop("_d")


def decision_events(ledger: DataFrame, accepted: DataFrame, base_event_id: int) -> DataFrame:
    """K3(b): one HUMAN event per accepted decision at the decision's own time, carrying the metric
    columns of the pending row it answers.  It supersedes that row and nothing newer, so the
    latest view of ledger + events equals the latest view of the in-place update (apart from
    timestamp and ids)."""
    d = accepted.select("application_id", F.col("seen_event_id").alias("event_id"), "decision", "clean_notes",
                        F.col("underwriter_id").alias("_u"), "event_ts")
    j = ledger.join(d, ["application_id", "event_id"], "inner")
    return numbered(j.select(
        F.lit("HUMAN").alias("event_type"),
        "application_id", "applicant_name", "system_recommendation", "calculated_dti",
        "net_monthly_surplus", "policy_breaches",
        F.col("_u").alias("underwriter_id"), F.col("decision").alias("underwriter_decision"),
        F.col("clean_notes").alias("underwriter_notes"), F.col("event_ts").alias("timestamp"),
        F.to_date("event_ts").alias("dt")), base_event_id)


# --- K4: reset -----------------------------------------------------------------------------------
def _reset_values(cond: Column) -> dict:
    return {
        "underwriter_decision": F.when(cond, F.lit(P.PENDING_REVIEW)).otherwise(F.col("underwriter_decision")),
        "underwriter_notes": F.when(cond, F.lit(P.NOT_AVAILABLE)).otherwise(F.col("underwriter_notes")),
        "underwriter_id": F.when(cond, F.lit(P.PENDING_REVIEW)).otherwise(F.col("underwriter_id")),
    }


def reset_in_place(ledger: DataFrame) -> DataFrame:
    """K4(a): every row whose recommendation is not AUTO_APPROVE goes back to pending.  A null
    recommendation is left alone (``!=`` on null is not true), as in SQL."""
    return ledger.withColumns(_reset_values(F.col("system_recommendation") != P.AUTO_APPROVE))


def reset_events(ledger: DataFrame, reset_ts: dt.datetime, base_event_id: int) -> DataFrame:
    """K4(b): a RESET event for each application whose *latest* row is not AUTO_APPROVE
    (resetting older rows would never show)."""
    cur = latest_agg(ledger).filter(F.col("system_recommendation") != P.AUTO_APPROVE)
    ts = F.greatest(wall_clock(reset_ts), F.col("timestamp"))
    rows = cur.withColumns(_reset_values(F.lit(True))).withColumns({
        "event_type": F.lit("RESET"),
        "timestamp": ts,
        "dt": F.to_date(ts),
    }).drop("event_id")
    return numbered(rows, base_event_id).select(*ledger.columns)


LEDGER_VIEW_COLUMNS = ("event_id",) + LEDGER_COLUMNS
