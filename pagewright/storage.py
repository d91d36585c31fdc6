"""Folders that driver and executors share."""

from __future__ import annotations

import functools
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def local_folder() -> str:
    """This process's own folder, for local sessions without a setting."""
    return tempfile.mkdtemp(prefix="pagewright-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder below ``spark.checkpoint.dir``; a path without a scheme is in Hadoop's default file system.

    Where the setting is missing, a local session uses a folder of this process; a cluster without it is an error.
    Nothing is set in the session.  Whoever asks for a folder deletes it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{local_folder()}"
    if "://" not in base:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        uri = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri()
        base = f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"
    return posixpath.join(base, f"pagewright-{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends here and its rows are fixed."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *folders: str) -> None:
    """Deletes folders that no later step reads."""
    for f in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
