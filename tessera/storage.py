"""Tables and folders on storage that all machines of a session share.

A table that cuts lineage is a Parquet folder below ``spark.checkpoint.dir``, so a lost
executor costs only the tasks that it ran. A folder of our own is used only where the
session names none and all runs on this machine; on a cluster without that setting,
what needs a table fails.
"""

from __future__ import annotations

import atexit
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else, on one machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"file:///tmp/checkpoints/tessera-{os.getuid()}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def release(since: int = 0, until: int | None = None) -> None:
    """Delete the folders that this process made, once results are written: all of them,
    or those between two marks. What cannot be deleted (its session may be closed) is
    left and does not hold up the others."""
    some = _written[since:until]
    del _written[since:until]
    for spark, path in some:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001
            continue


def mark() -> int:
    """The number of folders made and not yet deleted, for ``release``."""
    return len(_written)


def folder(spark: SparkSession, name: str) -> str:
    """A new path on shared storage, deleted in the end."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
