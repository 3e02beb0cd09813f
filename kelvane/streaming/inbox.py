"""A watched folder of ingest batches: each micro-batch's files go through the write path, one version per file.

An extension of the batch path; jobs and batches arrive as files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.plans.ingest import ingest
from kelvane.sources.store import VersionStore


def watch(spark: SparkSession, inbox: str, store: VersionStore, checkpoint: str, *, today: str, on_outcome=None, **options):
    """Starts the query and returns it; it takes what is there (availableNow) and ends. Run it again, or on a timer, for new files."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").load(inbox).select("path", "modificationTime")

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("modificationTime", "path").select("path").collect():  # file names of one micro-batch
            outcome = ingest(spark, store, row["path"], today=today, **options)
            if on_outcome:
                on_outcome(row["path"], outcome)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_counts(spark: SparkSession, root: str) -> DataFrame:
    """A stream of jobs by mode and status."""
    from kelvane.sources.store import JOB_SCHEMA

    return spark.readStream.schema(JOB_SCHEMA).option("pathGlobFilter", "auftrag_*.json").option("multiLine", True).json(root).groupBy("modus", "status").agg(F.count("*").alias("n"))
