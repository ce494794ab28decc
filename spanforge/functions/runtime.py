"""Getting this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Let workers import this package wherever they run; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="spanforge-"), "spanforge.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("spanforge", os.path.relpath(path, package)))
    context.addPyFile(target)  # Spark serves it to every executor
    _SHIPPED[context.applicationId] = target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, wherever it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def opened(path: str):  # noqa: ANN201
    """pyarrow's file system for a file or folder and its path there; plain paths are local. For code that runs in tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
