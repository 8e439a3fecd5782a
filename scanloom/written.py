"""The folder that driver and executors share, and tables that are written there once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, an error on a cluster, a folder of our own on one machine (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: For tables that are written for a run only: file: paths without checksum files.  Without Hadoop's native library each
#: file and each checksum file costs a chmod process, and a process that is being started counts as large as the JVM.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@contextmanager
def plain_files(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside write file: paths without checksum files. A file system that the user has set stays."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if any(conf.get(name) for name in PLAIN_FILES):
        yield
        return
    for name, value in PLAIN_FILES.items():
        conf.set(name, value)
    try:
        yield
    finally:
        for name in PLAIN_FILES:
            conf.unset(name)


def written(df: DataFrame) -> DataFrame:
    """The rows, in their partitions and order, written once: they survive lost executors, and the plan before them is done with."""
    shared_folder(df.sparkSession)
    with plain_files(df.sparkSession):
        return df.checkpoint()
