"""Shared helpers of the training-data operators: reading tables, shared scratch tables, small column idioms."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
#: The folder of a local application that names none, by application id.
_LOCAL_DIRS: dict[str, str] = {}
#: Most bytes of one Arrow batch on its way to a Python worker, or one row of any size: it bounds both sides' memory.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the folder may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local session (tests) gets a fresh local folder, once an application; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            own = spark.sparkContext.applicationId
            if own not in _LOCAL_DIRS:
                _LOCAL_DIRS[own] = Path(tempfile.mkdtemp(prefix="terravane-")).as_uri()
            found = _LOCAL_DIRS[own]
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the reread table.

    It cuts lineage: a lost executor costs a reread of files, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terravane/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._terravane_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    path = getattr(df, "_terravane_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone by now; the folder belongs to the cluster's own clean-up then
            return


def in_batches(df: DataFrame, run, schema, most: int = BATCH_BYTES) -> DataFrame:
    """df.mapInArrow in batches of at most so many bytes, whatever the length of the rows.

    The bound is a setting of the session, read when the plan runs. It is only ever lowered, so a plan that has not run yet keeps its bound, and
    so does a caller who set a lower one.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(name) or "")
    if not (now and 0 < int(now[1]) <= most):
        conf.set(name, str(most))
    return df.mapInArrow(run, schema)


def small(df: DataFrame, bound: int) -> DataFrame:
    """df marked for broadcast if a count shows at most `bound` rows, else as it is. Give a written table: it is read twice."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def let(value: Column, body) -> Column:
    """Bind value to a name inside one expression, so that it is evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str) -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(name), F.lit(""))
