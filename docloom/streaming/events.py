"""The event log as a stream: daily totals, running budgets, exactly-once output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of the events table as they arrive, in any order."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    own = f"{sf_dir}/events.parquet"
    kind = spark._jvm.org.apache.hadoop.fs.Path(own)
    folder = kind.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(kind).isDirectory()
    s = s if folder else s.option("pathGlobFilter", "events.parquet")
    return s.option("maxFilesPerTrigger", files_per_batch).parquet(own if folder else sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(events: DataFrame) -> DataFrame:
    """Totals per calendar day and type.

    There is no watermark: a file may arrive at any time and its rows still count.  State is
    one row per day and type, so the calendar bounds it.
    """
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def spend_by_run(events: DataFrame, budget: float) -> DataFrame:
    """Running spend per user, summed map-side, and whether it has passed the budget."""
    s = events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("spent"))
    return s.withColumn("over", (F.col("spent") > budget).cast("int"))


def drain(df: DataFrame, mode: str) -> DataFrame:
    """Run to the end of the available input; each batch overwrites its own folder, so replays are idempotent."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/s-{uuid.uuid4().hex}"

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/epoch={epoch:08d}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")


def latest(updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Final value of each key from an update stream."""
    g = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return g.select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])
