"""Packages checked as they arrive in a folder.

Rules look at one document at a time, so there is no state and nothing is late: each
micro-batch is a batch of packages, and its findings are appended with the batch's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import document_rules
from ..sources import packages as P

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*.docx", files_a_batch: int = 1000) -> DataFrame:
    """(doc, content) of the files that come to folder, as a stream."""
    rows = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch)
    return rows.load(folder).select(F.col("path").alias("doc"), "content")


def watch(spark: SparkSession, folder: str, findings: str, checkpoint: str, limits: P.Limits = P.Limits(), once: bool = False) -> StreamingQuery:
    """Findings of arriving files as Parquet under `findings`, a folder for each batch: a batch
    that is run again after a failure replaces its own folder. once: what is there now, then end."""

    def check(batch: DataFrame, number: int) -> None:
        out = document_rules.check(batch, limits).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{findings}/batch={number}")

    writer = arriving(spark, folder).writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
