"""Tables that a job writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of this session where it is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("blockyard.scratch", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-blockyard-")
        spark.conf.set("blockyard.scratch", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a cache it outlives executors, and a plan that reads it several times computes it once.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
