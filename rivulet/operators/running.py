"""Frames over arrival order."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    """All keys empty: one partition, as a global running value needs a total order."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)


def up_to_now(keys: list[str], order: list[str]) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_now(keys: list[str], order: list[str]) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def from_next(keys: list[str], order: list[str]) -> WindowSpec:
    return ordered(keys, order).rowsBetween(1, Window.unboundedFollowing)


def last_n(keys: list[str], order: list[str], n: int) -> WindowSpec:
    return ordered(keys, order).rowsBetween(-(n - 1), Window.currentRow)
