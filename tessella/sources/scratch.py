"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where none is set, a local master's temporary folder."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        path = _OWN.setdefault(context.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        _OWN[context.applicationId] = path
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
