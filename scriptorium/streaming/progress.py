"""Counts of a stream's results while it runs.

`watched` has Spark count the rows of each batch as they pass, in the plan itself; a
listener on the driver adds the batches' counts up.  A batch that is run again after a
failure replaces its own counts.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

_NAME = "scriptorium results"


def watched(stream: DataFrame, status: str = "status") -> DataFrame:
    """The stream, whose batches tell how many results they have, and of which status (true, false or null)."""
    c = F.col(status)
    return stream.observe(_NAME, F.count(F.lit(1)).alias("total"), F.count_if(c).alias("matched"), F.count_if(~c).alias("failed"), F.count_if(c.isNull()).alias("unmatched"))


class Progress(StreamingQueryListener):
    """Adds up the watched batches of all queries of a session; `expected` says how many results there will be."""

    def __init__(self, spark: SparkSession, expected: int | None = None):
        self.spark, self.expected = spark, expected
        self.batches: dict[tuple[str, int], dict[str, int]] = {}
        self.changed = threading.Condition()
        spark.streams.addListener(self)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        row = event.progress.observedMetrics.get(_NAME)
        if row is not None:
            with self.changed:
                self.batches[str(event.progress.id), event.progress.batchId] = row.asDict()
                self.changed.notify_all()

    def counts(self) -> dict[str, float | int | None]:
        """total, matched, failed and unmatched so far; progress is the share of what is expected, null if that is nothing or unknown."""
        with self.changed:
            out: dict[str, float | int | None] = {k: sum(b[k] for b in self.batches.values()) for k in ("total", "matched", "failed", "unmatched")}
        return out | {"progress": out["total"] / self.expected if self.expected else None}

    def wait(self, batches: int, seconds: float = 60) -> bool:
        """Whether so many batches have told their counts; these come a little after the batch."""
        with self.changed:
            return self.changed.wait_for(lambda: len(self.batches) >= batches, seconds)

    def close(self) -> None:
        self.spark.streams.removeListener(self)
