"""Predicates that are built from optional parameters."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_all(df: DataFrame, conditions: Iterable[Column | None]) -> DataFrame:
    """Rows for which all given conditions hold; None is no condition."""
    given = [c for c in conditions if c is not None]
    return df.filter(functools.reduce(lambda a, b: a & b, given)) if given else df


def equal(column: str, value: object | None) -> Column | None:
    return None if value is None else F.col(column) == value


def one_of(column: str, values: list | None) -> Column | None:
    return None if values is None else F.col(column).isin(*values)


def between(column: str, low: object | None, high: object | None) -> Column | None:
    if low is None and high is None:
        return None
    if low is None:
        return F.col(column) <= high
    return F.col(column) >= low if high is None else F.col(column).between(low, high)


def contains_ignoring_case(column: str, term: str | None) -> Column | None:
    """The term as data: its percent and underscore signs are no wildcards."""
    return None if term is None else F.contains(F.lower(F.col(column)), F.lower(F.lit(term)))


def tag_overlap(a: Column, b: Column) -> Column:
    """Common tags over the larger list's size; 0 without tags."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(0.0))


def any_between(columns: list[str], low: object | None, high: object | None) -> Column | None:
    """Whether one of the columns is in the range."""
    ranges = [r for c in columns if (r := between(c, low, high)) is not None]
    return functools.reduce(lambda a, b: a | b, ranges) if ranges else None


def holds_all(json: str, values: list[str]) -> Column:
    """Whether a JSON array of strings contains each value; unknown where it is null."""
    told = F.from_json(F.col(json), "array<string>")
    return functools.reduce(lambda a, b: a & b, [F.array_contains(told, v) for v in values], told.isNotNull())


def any_object(json: str, schema: str, test) -> Column:
    """Whether an object of a JSON array passes; false for an empty or a null one."""
    return F.coalesce(F.exists(F.from_json(F.col(json), f"array<struct<{schema}>>"), test), F.lit(False))
