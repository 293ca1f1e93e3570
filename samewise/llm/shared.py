"""The folder that driver and executors share, and how workers read files there."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from ..storage import fresh, root, staged

__all__ = ["drop", "file_system", "fresh", "partitions", "root", "staged"]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever its file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a folder, for workers that read ranges of files there."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
