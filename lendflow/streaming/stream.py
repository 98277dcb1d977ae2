"""Structured Streaming forms of the assessment and ledger jobs.

Z1  payload files land in a directory -> quarantine -> assess -> ledger rows, per micro-batch.
Z2  repeated submissions go to the rejects with a reason.
Z3  decision counts per event-time window with a watermark (the live dashboard).
Z4  latest state per application kept as a change log that is folded into a snapshot.
A1  dashboard counts kept as signed changes: a batch costs what it touches, not a pass over the ledger.

Every payload that lands is accounted for: ledger rows + rejects = payloads.  Nothing is dropped by a
watermark: a file counts when it arrives, however old it is.  Sinks are idempotent by batch id: a
retried batch overwrites its own output directories, so a restart never adds a batch twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lendflow import params as P
from lendflow.operators import dashboard, ledger
from lendflow.plans.assess import assess_applications
from lendflow.sources.payloads import CORRUPT, DUPLICATE, READ_SCHEMA, reject_reasons, submission_key
from lendflow.sources.schemas import LEDGER_SCHEMA
from lendflow.streaming import state


def payload_stream(spark: SparkSession, payload_dir: str, max_files: int | None = None,
                   multi_line: bool = True) -> DataFrame:
    """Payload files as a stream (explicit schema; ``multi_line``: one object per file).  ``submitted_at`` is the file's
    modification time and ``payload_file`` its path.  The source would ignore files more than a week
    older than the newest it has seen; ten years take in backfilled ones."""
    r = spark.readStream.schema(READ_SCHEMA).option("multiLine", multi_line).option("maxFileAge", "3650d")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.json(payload_dir)
    return df.withColumns({"submitted_at": F.col("_metadata.file_modification_time"),
                           "payload_file": F.col("_metadata.file_path")})


def _batch_dir(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch={batch_id}"


def assess_stream(spark: SparkSession, payload_dir: str, ledger_root: str, rejects_root: str,
                  checkpoint: str, p=P.DEFAULT_POLICY, once: bool = True, dedupe: bool = True,
                  repeat_days: int = 30, max_files: int | None = 10_000, index=None,
                  completions: DataFrame | None = None, multi_line: bool = True) -> StreamingQuery:
    """Z1 + Z2: every micro-batch of at most ``max_files`` payloads is assessed with the batch plan.

    Rows are quarantined first (S4).  Of the valid rows, a submission that repeats one of the same
    batch, or one taken in the last ``repeat_days`` (keyed state with a time to live: a batch reads the
    state of its own keys only), goes to the rejects as well.  The rest is assessed (with ``index`` and
    ``completions`` as in the batch job) and written under ``<ledger>/batch=<id>/dt=...``; ids are
    ``batch id * 2^32`` plus the row's number.  ``multi_line``: one object per file, else one per line."""
    src = payload_stream(spark, payload_dir, max_files, multi_line)
    src = src.withColumn("reject_reasons", reject_reasons(src, p))
    if dedupe:
        key = F.when(F.size("reject_reasons") == 0, submission_key())
        src = state.mark_repeats(src, key, "submitted_at", "payload_file", repeat_days)
        src = src.withColumn("reject_reasons", F.when(F.col("repeated"), F.array(F.lit(DUPLICATE)))
                             .otherwise(F.col("reject_reasons"))).drop("repeated")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            valid = batch.filter(F.size("reject_reasons") == 0).drop("reject_reasons", CORRUPT)
            rejected = batch.filter(F.size("reject_reasons") > 0)
            # submitted_at rides along through the assessment: no join back by id
            out, none = assess_applications(valid, p, index, completions)
            ts = F.coalesce(F.col("submitted_at"), F.current_timestamp()).cast("timestamp_ntz")
            rows = ledger.numbered(ledger.audit_rows(out, ts).drop("event_id"), ledger.run_base(batch_id))
            ledger.write_run(rows, ledger_root, batch_id)
            (rejected.unionByName(none, allowMissingColumns=True)
             .write.mode("overwrite").parquet(_batch_dir(rejects_root, batch_id)))
        finally:
            batch.unpersist()

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return state.start(w, spark)


def finish(started: StreamingQuery) -> None:
    """Waits for a stream that reads what is there; its fault is raised."""
    started.awaitTermination()


def read_stream_ledger(spark: SparkSession, ledger_root: str) -> DataFrame:
    """All ledger rows written by ``assess_stream``: the batch job's layout."""
    return ledger.read_ledger(spark, ledger_root)


# --- Z3 -----------------------------------------------------------------------------------------
def ledger_stream(spark: SparkSession, ledger_dir: str) -> DataFrame:
    return spark.readStream.schema(LEDGER_SCHEMA).parquet(ledger_dir)


def windowed_decisions(stream: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Z3: decision counts per tumbling window; a window is final once the watermark passes it.
    Watermarks need a zoned timestamp: the ledger's wall-clock time is read in the session zone
    (UTC) and the window bounds are turned back into wall-clock values."""
    s = stream.withColumn("_event_time", F.col("timestamp").cast("timestamp")).withWatermark("_event_time", delay)
    out = (s.groupBy(F.window("_event_time", width).alias("w"), "underwriter_decision")
           .agg(F.count(F.lit(1)).alias("n")))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), "underwriter_decision", "n")


# --- Z4 -----------------------------------------------------------------------------------------
def latest_changes(stream: DataFrame) -> DataFrame:
    """Newest row per application as a stateful streaming aggregation.  The state store keeps
    one row per application; in ``update`` mode each micro-batch emits only the applications it
    touched, so the work per batch follows the batch, not the size of the state."""
    cols = [c for c in stream.columns if c != "application_id"]
    agg = stream.groupBy("application_id").agg(
        F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in ledger.ORDER_KEY])).alias("_row"))
    return agg.select("application_id", "_row.*")


def latest_state_stream(spark: SparkSession, ledger_dir: str, changes_root: str, checkpoint: str,
                        once: bool = True) -> StreamingQuery:
    """Z4 sink: each batch's changed states go to ``<changes_root>/batch=<id>`` (overwrite:
    idempotent on retry).  ``read_state`` folds the change log into the current state."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_dir(changes_root, batch_id))

    w = (latest_changes(ledger_stream(spark, ledger_dir)).writeStream.outputMode("update")
         .foreachBatch(write).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()


SNAPSHOT = "batch=-1"                 # the folded state stands beside the batches it replaces


def read_state(spark: SparkSession, changes_root: str) -> DataFrame | None:
    """Current latest state: the newest change per application (one partial aggregate over the
    snapshot and the changes since), or None before the first batch."""
    if not ledger.path_exists(spark, changes_root):
        return None
    return ledger.latest_agg(spark.read.parquet(changes_root).drop("batch"))


def fold_state(spark: SparkSession, changes_root: str, before: int) -> None:
    """Fold the snapshot and all batches below ``before`` into a new snapshot, so the log does not grow
    with the stream's age.  Batches from ``before`` on are not touched.  Changes are idempotent (the newest
    wins), so a fold that died is mended by running it again."""
    from lendflow.session import materialize
    root = changes_root.rstrip("/")
    log = spark.read.parquet(root).filter(F.col("batch") < before)
    batches = [r[0] for r in log.select("batch").distinct().collect() if r[0] >= 0]       # one row per batch
    if not batches:
        return
    staged = materialize(ledger.latest_agg(log.drop("batch")), "state")
    staged.write.mode("overwrite").parquet(f"{root}/{SNAPSHOT}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for b in batches:
        old = hadoop(f"{root}/batch={b}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


# --- A1, live -----------------------------------------------------------------------------------
COUNT_GROUPS = ("system_recommendation", "underwriter_decision")


def live_counts_stream(spark: SparkSession, ledger_dir: str, counts_root: str, checkpoint: str,
                       once: bool = True) -> StreamingQuery:
    """Each batch's changes of the counts by recommendation and decision go to ``<counts_root>/batch=<id>``, one row
    per group it touched.  A retried batch starts from the same state and overwrites the same rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        moved = batch.groupBy(*COUNT_GROUPS).agg(F.sum("n").alias("n")).filter("n <> 0")
        moved.coalesce(1).write.mode("overwrite").parquet(_batch_dir(counts_root, batch_id))

    w = (state.count_changes(ledger_stream(spark, ledger_dir), *COUNT_GROUPS).writeStream
         .foreachBatch(write).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return state.start(w, spark)


def read_counts(spark: SparkSession, counts_root: str) -> DataFrame:
    """Applications by recommendation and decision of their newest row (recommendation, decision, n)."""
    columns = ", ".join(f"{g} string" for g in COUNT_GROUPS)
    return (spark.read.schema(f"{columns}, n long, batch long").parquet(counts_root)
            .groupBy(*COUNT_GROUPS).agg(F.sum("n").alias("n")).filter("n <> 0"))
