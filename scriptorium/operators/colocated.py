"""Tables that lie by key, so that joins on it move nothing, and issues by year, so that others are not read.

`by_key` writes tables of one archive bucketed and sorted by their common key: joins of
them on the key, and aggregates by it, need no exchange.  `by_year` writes issues in a
folder a year: a join with the years wanted reads those folders only, which Spark finds out while the query runs.

Rows of a key that is very common lie in one bucket's files; a join of such a key is
the user's to salt.  Null keys join with nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.folder import new_folder
from scriptorium.functions import ranges

BUCKETS = 32


class Archive:
    """Tables bucketed by one key, by name; they go when the application ends."""

    def __init__(self, spark: SparkSession, key: str = "ark", buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.folder, self.prefix, self.names = new_folder(spark, "archive"), f"archive_{uuid.uuid4().hex}", {}

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes a table by key; the table as it lies there."""
        table = f"{self.prefix}_{name}"
        dealt = rows.repartition(self.buckets, self.key)  # a task a bucket, so a bucket is one file
        dealt.write.mode("overwrite").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.folder}/{name}").saveAsTable(table)
        self.names[name] = table
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def close(self) -> None:
        """Forgets the tables; their files go with the folder."""
        for table in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.names = {}


def by_year(issues: DataFrame, year: str, path: str) -> DataFrame:
    """Writes issues in a folder a year; the table as it lies there."""
    issues.repartition(F.col(year)).write.mode("overwrite").partitionBy(year).parquet(path)
    return issues.sparkSession.read.schema(issues.drop(year).schema.add(issues.schema[year])).parquet(path)


def issues_wanted(serials: DataFrame, years: str, serial: str, issues: DataFrame, issue_serial: str, issue_year: str) -> DataFrame:
    """`matching.possible_issues` of issues that lie by year: of the years wanted and those beside them, each once.

    Years have four digits, so those that any serial wants are 10,000 at most; they are known before issues are read.
    """
    wanted = serials.select(serial, F.explode(ranges.year_window(F.col(years))).alias("wanted")).where(F.col("wanted").between(0, 9999)).distinct()
    some = F.broadcast(wanted.select("wanted").distinct())
    near = issues.join(some, F.col(issue_year) == F.col("wanted"), "left_semi")
    return wanted.join(near, (F.col(serial) == F.col(issue_serial)) & (F.col("wanted") == F.col(issue_year)))


def issue_contents(archive: Archive, meta: str = "meta", page_map: str = "page_map", entries: str = "entries") -> DataFrame:
    """Each issue's metadata with its number of views, its last numbered page, and its entries in order; none where it has no contents.

    All tables lie by key, so nothing moves.
    """
    views = archive.table(page_map).groupBy(archive.key).agg(F.count("*").alias("views"), F.coalesce(F.expr("max_by(ordre, pos) filter (where pagination_type = 'A')"), F.min_by("ordre", "pos")).alias("last_pno"))
    return archive.table(meta).join(views, archive.key).join(archive.table(entries), archive.key, "left")
