"""Shared helpers of the training-data operators: text columns, row digests, intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Intermediate Parquet tables of one operator call in the shared checkpoint folder.

    Every table is written once and read back, so a lost executor costs one stage, not
    the whole job.  The owner calls :meth:`drop` when the final result has been stored.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def store(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)  # frees its buffers at once; snappy's are direct memory, kept until a full collection
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, everything else untouched."""
    return F.translate(c, UPPER, LOWER)


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % n


def documents(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id and text (null: empty), and nothing else unless asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, rows: int = 256) -> DataFrame:
    """mapInArrow over column dictionaries of at most ``rows`` rows; fn yields column dictionaries."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)

    def run(batches):
        def pieces():
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    yield b.slice(at, rows).to_pydict()

        for made in fn(pieces()):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, out)
