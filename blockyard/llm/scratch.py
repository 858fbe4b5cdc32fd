"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset (tests), a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("blockyard.scratch", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-blockyard-")
        spark.conf.set("blockyard.scratch", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Tell the session to hand Python batches of a few MB: batches of 10,000 texts take that many times over in both processes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def input_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, over all rows; sizes hash partitions so that one fits in a task."""
    from pyspark.sql import functions as F

    return int(docs.agg(F.sum(F.octet_length(F.col(column))).alias("b")).first()["b"] or 0)
