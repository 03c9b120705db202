"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def text(column: Column | str) -> Column:
    """A missing value reads as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def literals(values: Iterable[str]) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])
