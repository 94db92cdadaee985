"""Cutting lineage with a written table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own_folders: dict[str, str] = {}

# Longest counted list of ids or keys (a few numbers each) that is broadcast.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    Only a local-mode session may fall back to a temporary folder of this machine, one per application; the
    session's own setting stays as it is.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    # "local-cluster" has executors of its own.
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="gridkin-")
    return _own_folders[application]


def stored_folder(spark: SparkSession) -> str:
    """Where this application stores its intermediates."""
    return f"{shared_folder(spark)}/gridkin/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{stored_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_stored(spark: SparkSession) -> None:
    """Delete what this application has stored; no result that still reads it may be in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stored_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Run a plan once and continue from its stored rows.

    Used where a result is read several times, or where its physical placement (a row position) has
    to stay what it was.  The files survive the loss of executors; ``remove_stored`` deletes them when the
    application is done with its results.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
