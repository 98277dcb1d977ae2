"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(master: str | None = None, app_name: str = "lendflow",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session with AQE, UTC and Arrow on and the web UI off.

    On a cluster ``master`` stays None and the launcher's settings win; locally (tests, bench)
    a ``local[N]`` master and a shuffle-partition count near the core count are passed in.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Remove checkpoint files once the checkpointed data is no longer referenced.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Streaming state (Z2 dedupe, Z3 windows, Z4 latest state) in RocksDB: off-heap, spills to
        # disk, checkpointed incrementally.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # Arrow batches for the few Python operators (recursive chunking, k-NN blocks)
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**conf, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster names it; only a local session (tests, bench) without one gets a fresh scratch
    folder of its own.  A cluster session without the setting is an error: a machine-local
    folder would not survive the loss of an executor.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="lendflow-ckpt-", dir=os.environ.get("LENDFLOW_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df, tag: str):
    """Cut lineage with a Parquet table written under the shared checkpoint folder and read back
    (columnar, so consumers prune and filter it like any table).  Used where one intermediate
    feeds several consumers and recomputing it would be costly."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def numbered(rows: DataFrame, base: int | Column = 0, name: str = "event_id") -> DataFrame:
    """``rows`` with consecutive ids from ``base``, however many partitions there are.  Sorted rows are
    numbered in their order, whatever the layout.

    The rows are written once to the shared folder, so both passes over them see the same partitions;
    the table of partition sizes has one row per partition and stays small."""
    staged = materialize(rows.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = staged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    start = base if isinstance(base, Column) else F.lit(base).cast("long")
    return (staged.withColumn("_p", part).join(F.broadcast(first), "_p")
            .withColumn(name, start + F.col("_first") + place).drop("_m", "_p", "_first"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``; any other fault of the file system is raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
