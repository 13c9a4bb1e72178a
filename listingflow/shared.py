"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without one a temporary folder, but only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="listingflow-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, label: str, rows_per_batch: int | None = None) -> DataFrame:
    """``df`` written once and read again: a cut in the lineage that survives lost executors.

    ``rows_per_batch``: of the Arrow batches while it is written, for rows that hold whole blocks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        if rows_per_batch:
            spark.conf.set(batch, rows_per_batch)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if rows_per_batch:
            spark.conf.set(batch, before)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes tables of :func:`staged` once nothing that is still to be computed reads them, not even after a lost executor."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
