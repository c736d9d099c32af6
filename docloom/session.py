"""Session settings the plans are written for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docloom", cores: str | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps.

    ``cores`` sets a local master; leave it unset on a cluster, where the master
    comes from spark-submit.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
    )
    if cores:
        b = (
            b.master(f"local[{cores}]")
            .config("spark.driver.memory", os.environ.get("DOCLOOM_DRIVER_MEMORY", "12g"))
            .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder that the cluster names in spark.checkpoint.dir."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        spark.sparkContext.setCheckpointDir(named)
        return
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def local_checkpoint_dir(spark: SparkSession) -> None:
    """For one machine only (tests, benchmarks): a temporary folder, removed at exit, where none is set."""
    unset = not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() and not spark.conf.get("spark.checkpoint.dir", None)
    if unset and spark.sparkContext.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="docloom-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise as a Parquet table in the shared checkpoint folder.

    Survives executor loss, is computed once (an RDD checkpoint computes twice),
    and gives the following joins exact sizes to choose a strategy by.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Tables whose rows carry long text: CPU per row is high, so few input splits would leave cores idle.
SMALL_BYTES = 256 << 20
TEXT_TABLES = {"documents", "pages", "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """Repartition a table of at most SMALL_BYTES that has fewer splits than the cluster has cores.

    Larger tables are never shuffled for this; their splits follow spark.sql.files.maxPartitionBytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
    return df.repartition(cores) if small and plan.toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df
