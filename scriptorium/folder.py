"""The folder that driver and executors share, for tables and files that outlive a stage."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, as an address; a temporary one only where none is set and all runs on one machine, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scriptorium-"))
        named = context.getCheckpointDir()
    return address(spark, named)


def address(spark: SparkSession, path: str) -> str:
    """A path with its file system; without a scheme it lies in the cluster's own."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    told = made.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(made).toString()
    return told.replace("file:/", "file:///", 1) if re.match("file:/[^/]", told) else told


def file_system(place: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of an address, in driver and tasks alike."""
    return pyarrow.fs.FileSystem.from_uri(place)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(made)  # what does not exist yet is not remembered for deletion
    fs.deleteOnExit(made)
    return path


def written(frame: DataFrame, path: str) -> DataFrame:
    """The table, written and read again: its lineage ends there."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
