"""Rows written to the folder that all executors share, and read back: what follows depends on files, not on executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. In local mode, where one machine is all there is, a folder of
    its own if none is named; on a cluster that is an error, as executors would not see the driver's files.
    """
    out = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if out:
        return out
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/lorekeep-checkpoints"


def settled(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def dropped(*rows: DataFrame) -> None:
    """Deletes what ``settled`` wrote for these; nothing may read them any more."""
    for df in rows:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
