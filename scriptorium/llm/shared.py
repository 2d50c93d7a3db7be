"""Working folders and sizes that hold on any cluster.

Whatever must outlive a stage goes to the folder that the cluster names in
`spark.checkpoint.dir`: driver and executors all see it, and a lost executor
takes nothing with it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What a row costs a task beside its text.
ROW_BYTES = 256


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as an address; a temporary one only where none is set and all runs on one machine, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scriptorium-"))
        named = context.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(named)  # without a scheme it lies in the cluster's own file system
    named = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return named.replace("file:/", "file:///", 1) if re.match("file:/[^/]", named) else named


def file_system(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of an address, in driver and tasks alike."""
    return pyarrow.fs.FileSystem.from_uri(address)


class Workspace:
    """A folder of its own under the shared one, holding tables of one operator's run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)  # what does not exist yet is not remembered for deletion
        fs.deleteOnExit(path)  # results are lazy: it must last until then

    def write(self, frame: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write a table and read it back: its lineage ends there."""
        frame.write.mode("overwrite").option("compression", codec).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing reads any more, or the whole folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ranges(docs: DataFrame, text_col: str, size: int) -> int:
    """Ranges of some `size` bytes of text, a row beside its text counting ROW_BYTES; as many as shuffles have at least."""
    total = docs.agg(F.sum(ROW_BYTES + F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // size))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
