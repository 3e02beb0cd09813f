"""What the corpus operators share: the tables, the word rule and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); set here only where it is unset and driver and executors are one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="kelvane-"))
    return sc.getCheckpointDir()


#: Bytes of an Arrow batch, so that a Python worker's memory doesn't grow with the length of texts.
BATCH_BYTES = 8_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, where the session has no bound of its own; by rows alone, 10,000 long texts would be one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a read and not the whole lineage.

    ``keep`` writes a frame and reads it back; ``drop`` removes tables that later steps have replaced.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0
        bounded_batches(spark)

    def keep(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sha256_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string column in UTF-8, null counting as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
