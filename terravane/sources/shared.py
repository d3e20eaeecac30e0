"""The folder that driver and executors share, for indexes and tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The folder of a local application that names none, by application id.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = spark.sparkContext.applicationId
        if own not in _LOCAL:
            _LOCAL[own] = Path(tempfile.mkdtemp(prefix="terravane-")).as_uri()
        found = _LOCAL[own]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/terravane/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df written as Parquet, in a folder for each value of the columns given, and read again."""
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.parquet(path)
