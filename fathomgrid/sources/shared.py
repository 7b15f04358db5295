"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. In local mode a temporary one is made if none is set; on a
    cluster that is an error, as executors would write to disks of their own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return (known or own.get()).rstrip("/")
    if not known and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    known = known or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as a table in the shared folder and read again, so that later steps don't compute it anew."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
