"""A keyed store as a log: the last version of a key wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last row of each key; partial aggregates leave the map side, no sort."""
    rest = [c for c in log.columns if c not in keys and c != version]
    out = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row"), F.max(version).alias(version))
    return out.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest], version)


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with more rows."""
    return log.unionByName(rows)


def probe(wanted: DataFrame, log: DataFrame, key: str, value: str, version: str, default: Column | None = None) -> DataFrame:
    """wanted with the stored value (or the default) and whether there was one."""
    held = latest(log.select(key, value, version), [key], version).select(key, F.col(value).alias("stored"), F.lit(True).alias("hit"))
    out = wanted.join(held, key, "left")
    return out.withColumns({"hit": F.coalesce("hit", F.lit(False)), "stored": F.coalesce("stored", default) if default is not None else F.col("stored")})


def misses(wanted: DataFrame, log: DataFrame, key: str, ignore: bool = False) -> DataFrame:
    """What has to be worked out; with `ignore`, everything."""
    return wanted if ignore else wanted.join(log.select(key).distinct(), key, "left_anti")


#: Stores by name, and the setting that turns each on; the first three are always on. Fixed values.
STORES = {"ark": None, "source_match": None, "ocr_bounds": None, "responses": "scriptorium.cache.responses", "data": "scriptorium.cache.data", "img_data": "scriptorium.cache.data"}
#: A setting that empties all stores for a session.
CLEAN = "scriptorium.cache.clean"


def named_store(log: DataFrame, name: str) -> DataFrame:
    """What the store of that name holds, of a log of all of them (name, key, value, version).

    Empty if the session turns it off or wants clean stores.
    """
    if name not in STORES:
        raise ValueError(f"no store named {name}; there are {sorted(STORES)}")
    conf = log.sparkSession.conf
    switch = STORES[name]
    on = conf.get(CLEAN, "false") != "true" and (switch is None or conf.get(switch, "false") == "true")
    return log.where((F.col("name") == name) & F.lit(on)).drop("name")


def argument_key(*columns: Column) -> Column:
    """The key of a call: its arguments, in order, as JSON with nulls kept."""
    return F.to_json(F.struct(*[c.cast("string").alias(f"a{k}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"})


def memoised(wanted: DataFrame, log: DataFrame, key: str, value: str, version: str, make: Callable[[DataFrame], DataFrame], ignore: bool = False) -> tuple[DataFrame, DataFrame]:
    """wanted with its value, from the log or else made; and the rows to append to the log.

    make takes the rows that are not stored (each key once) and returns key and
    value.  A stored null or '' counts as not stored.  With `ignore` everything is
    made, and still appended, so it wins over what was stored.
    """
    held = latest(log.select(key, value, version), [key], version)
    good = held.where(F.col(value).isNotNull() & (F.length(F.col(value).cast("string")) > 0))
    made = make(misses(wanted.dropDuplicates([key]), good, key, ignore)).select(key, value)
    known = made if ignore else good.select(key, value).unionByName(made)
    newest = log.agg(F.coalesce(F.max(version), F.lit(0)).alias("newest"))
    rows = made.crossJoin(F.broadcast(newest)).select(key, value, (F.col("newest") + 1).cast(log.schema[version].dataType).alias(version))  # one row on that side
    return wanted.join(known, key, "left"), rows
