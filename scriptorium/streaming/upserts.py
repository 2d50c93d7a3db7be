"""Rows of a stream that change what a key holds.

Each key's newest row is value state.  A row comes out if its version is above all that
came before for its key, so late and repeated rows are passed over; of a batch's rows of one
key only the newest comes out.  What came out, put together, is a log whose last version
of each key is the stream's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where keyed state lives: value state needs this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Newest(StatefulProcessor):
    """Keeps each key's greatest version, and lets newer rows out."""

    def __init__(self, columns: list[str], version: str):
        self.columns, self.version = columns, version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("version", T.StructType([T.StructField("version", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            part = part[part[self.version].notna()]
            if len(part):
                one = part.sort_values(self.version, kind="stable").iloc[[-1]]
                if best is None or one[self.version].iloc[0] > best[self.version].iloc[0]:
                    best = one
        known = self.held.get()
        if best is not None and (known is None or best[self.version].iloc[0] > known[0]):
            self.held.update((int(best[self.version].iloc[0]),))
            yield best[self.columns]

    def close(self) -> None:
        pass


def changes(stream: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The rows that were newest of their key when they came; version is a long, rows without one are passed over."""
    name, setting = PROVIDER
    if stream.sparkSession.conf.get(name, "") != setting:
        raise ValueError(f"set {name} to {setting}")
    return stream.groupBy(*keys).transformWithStateInPandas(Newest(stream.columns, version), outputStructType=stream.schema, outputMode="Update", timeMode="None")
