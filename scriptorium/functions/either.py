"""A value or an error: a struct of both, of which one is null.

An error that is null and a value that is null make a null that is no error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def right(value: Column, error_type: str = "string") -> Column:
    return F.struct(value.alias("value"), F.lit(None).cast(error_type).alias("error"))


def left(error: Column, value_type: str) -> Column:
    return F.struct(F.lit(None).cast(value_type).alias("value"), error.alias("error"))


def of(value: Column, error: Column) -> Column:
    """The value, unless there is an error."""
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def mapped(either: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value; an error stays."""
    return F.struct(F.when(either["error"].isNull(), f(either["value"])).alias("value"), either["error"].alias("error"))


def flat_mapped(either: Column, f: Callable[[Column], Column]) -> Column:
    """f, which gives a value or an error itself, of a value; an error stays."""
    then = f(either["value"])
    return F.struct(F.when(either["error"].isNull(), then["value"]).alias("value"), F.coalesce(either["error"], then["error"]).alias("error"))


def value_or(either: Column, default: Column) -> Column:
    return F.when(either["error"].isNull(), either["value"]).otherwise(default)


def traversed(eithers: Column, value_type: str) -> Column:
    """An array of them as one: all values in order, or the first error."""
    errors = F.filter(F.transform(eithers, lambda e: e["error"]), lambda e: e.isNotNull())
    return of(F.transform(eithers, lambda e: e["value"]).cast(f"array<{value_type}>"), F.get(errors, F.lit(0)))
