"""Tables in the folder that all executors share: they cut lineage, so that a lost executor costs a re-read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; the warehouse only where it is in a store of its own or all runs in one process."""
    context = spark.sparkContext._jsc.sc()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and context.getCheckpointDir().isDefined():
        base = context.getCheckpointDir().get()
    if base:
        return base.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if (warehouse.startswith(("/", "file:")) or "://" not in warehouse) and not context.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_shared"


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/threadloom/{kind}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
