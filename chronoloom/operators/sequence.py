"""Comparison with earlier and later rows of the same group."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import day_diff, flag
from chronoloom.operators.timeline import Timeline


def with_prev(
    line: Timeline, columns: Mapping[str, str | Column], steps: int = 1
) -> Timeline:
    """Add output name -> value of a column or expression ``steps`` rows earlier."""
    return line.neighbours(
        lambda w: {name: F.lag(c, steps).over(w) for name, c in columns.items()}, back=steps
    )


def with_next(
    line: Timeline, columns: Mapping[str, str | Column], steps: int = 1
) -> Timeline:
    """Add output name -> value of a column or expression ``steps`` rows later."""
    return line.neighbours(
        lambda w: {name: F.lead(c, steps).over(w) for name, c in columns.items()}, ahead=steps
    )


def had_before(line: Timeline, marker: str, name: str) -> Timeline:
    """Largest value of a 0/1 marker over all earlier rows; NULL on the first row."""
    return line.running({name: ("max", F.col(marker), "before")})


def monotone_run(
    line: Timeline, column: str, names: Iterable[str], name: str, direction: str = "up"
) -> Timeline:
    """Flag rows whose value, with the ones just before, strictly rises (or falls).

    ``names`` are the output columns for the previous values, nearest first; their number sets
    how many steps are compared.
    """
    names = list(names)
    earlier = line.neighbours(
        lambda w: {n: F.lag(column, i).over(w) for i, n in enumerate(names, 1)}, back=len(names)
    )
    condition = F.lit(True)
    for later, before in zip([column, *names], names):
        pair = (
            F.col(later) > F.col(before) if direction == "up" else F.col(later) < F.col(before)
        )
        condition = condition & pair
    return earlier.with_columns({name: flag(condition)})


def inactivity_intervals(
    events: DataFrame,
    key: str,
    ts: str,
    tie: Iterable[str],
    *,
    began: str,
    resumed: str,
    days: str,
    following: str | None = None,
) -> DataFrame:
    """One row per pair of consecutive events of a key, with the calendar days between them.

    With ``following`` the event after the pair is added too.
    """
    tie = list(tie)
    line = Timeline.measured(events.select(key, ts, *tie), [key], [ts, *tie])

    def around(w):
        columns = {began: F.lag(ts).over(w)}
        if following:
            columns[following] = F.lead(ts).over(w)
        return columns

    pairs = line.neighbours(around, back=1, ahead=1 if following else 0).filter(
        F.col(began).isNotNull()
    )
    extra = [following] if following else []
    return pairs.rows().select(
        key, began, F.col(ts).alias(resumed), day_diff(began, ts).alias(days), *extra
    )
