"""Record files as they arrive in a folder.

Each new file is read once, by its format; records seen before, by their key, within the
watermark are dropped.  What the sink gets is what the batch readers give.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.sources import archive, entries


def record_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A streaming DataFrame of the records of a folder's files, each read by the end of its name, with `key` and the time of arrival.

    What is new of a file that has grown is read from where the last batch ended.
    """
    parts = [fields(entries.stream(spark, form, folder, **options)) for form, fields in archive.FORMATS.values()]
    arrived = reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), parts)
    return arrived.withColumns({"key": F.sha1("raw"), "arrived": F.current_timestamp()})


def distinct_records(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first of records with equal text within the delay."""
    return stream.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["key"])


def start_matching(stream: DataFrame, match: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch matcher on every arrival and appends its results as Parquet, once for each batch."""

    def step(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
