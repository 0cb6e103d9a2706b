"""Trailing baselines and tests against them or against the previous period."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from chronoloom.functions import flag


def trailing_mean(column: str, rows: int, window: WindowSpec) -> Column:
    """Mean of the ``rows`` rows before the current one; NULL when there is none.

    Sum and count are kept apart so that decimal input is summed exactly.
    """
    before = window.rowsBetween(-rows, -1)
    return F.try_divide(
        F.sum(column).over(before).cast("double"), F.count(column).over(before).cast("double")
    )


def trailing_sum(column: str, rows: int, window: WindowSpec) -> Column:
    """Sum over the current row and the ``rows - 1`` before it."""
    return F.sum(column).over(window.rowsBetween(1 - rows, 0))


def deviates(value: str, baseline: str, tolerance: float) -> Column:
    """1 where the value is off its baseline by more than the tolerated share, either way."""
    return flag(F.abs(F.col(value) - F.col(baseline)) > F.col(baseline) * tolerance)


def exceeds(value: str, baseline: str, factor: float) -> Column:
    """1 where the value is above ``factor`` times its baseline."""
    return flag(F.col(value) > F.col(baseline) * factor)


def drop_vs_prev(value: str, previous: str, factor: float, positive_only: bool = True) -> Column:
    """1 where the value is at most ``factor`` times the previous one."""
    known = F.col(previous) > 0 if positive_only else F.col(previous).isNotNull()
    return flag(known & (F.col(value) <= F.col(previous) * factor))


def recovery_vs_prev(value: str, previous: str, factor: float) -> Column:
    """1 where the value is at least ``factor`` times a positive previous one."""
    return flag((F.col(previous) > 0) & (F.col(value) >= F.col(previous) * factor))
