"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


@atexit.register
def _drop_own() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this process only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="rivulet-"))
    return "file://" + _OWN[0]


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
