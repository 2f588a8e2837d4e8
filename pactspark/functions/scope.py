"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An outer expression used inside a lambda of a higher-order function is
    evaluated again for every element; passing it through a one-element array
    turns it into a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(count: Column) -> Column:
    """``[0, 1, …, count - 1]``, empty for zero (``sequence`` would count down)."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
