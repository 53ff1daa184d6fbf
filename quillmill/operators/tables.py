"""Tables written where all executors can read them, so that plans and lineage start there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. One of this machine stands in only where
    that is unset and all tasks run on this machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: later queries read only the
    columns and rows they ask for, and a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmill/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.stored_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that cut() made and that nothing reads again."""
    for df in tables:
        at = df.__dict__.pop("stored_at", None) if df is not None else None
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
