"""Gaps and islands: number and summarise stretches of anomalous rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import boundary_diff, flag
from chronoloom.operators.timeline import Timeline

# When a new island starts, with a = row is anomalous and g = there was a gap before it.
BREAK = "break"  # g, or not a
ONSET = "onset"  # a, and it is the first row, or the one before was normal, or g
EVENT = "event"  # a, or g
FIRST_OR_GAP = "first_or_gap"  # a, and it is the first row or g


def gap_flag(
    unit: str, previous: str, current: str, limit: int, first_is_gap: bool = True
) -> Column:
    """1 where more than ``limit`` unit boundaries lie between two rows."""
    far = boundary_diff(unit, previous, current) > limit
    return flag((F.col(previous).isNull() | far) if first_is_gap else far)


def start_flag(
    policy: str,
    anomalous: str,
    gap: str,
    previous_time: str | None = None,
    previous_anomalous: str | None = None,
) -> Column:
    """1 on rows that start an island under the given policy."""
    a, g = F.col(anomalous) == 1, F.col(gap) == 1
    if policy == BREAK:
        return flag(g | ~a)
    if policy == EVENT:
        return flag(a | g)
    first = F.col(previous_time).isNull()
    if policy == FIRST_OR_GAP:
        return flag(a & (first | g))
    if policy == ONSET:
        return flag(a & (first | g | (F.col(previous_anomalous) == 0)))
    raise ValueError(f"unknown policy {policy!r}")


def assign_islands(
    line: Timeline, start: Column, frame: str = "rows", island: str = "grupo_id"
) -> Timeline:
    """Number the islands of each group by counting their starts so far."""
    return line.running({island: ("sum", start, frame)})


def summarize_islands(
    rows: DataFrame, keys: Iterable[str], aggregates: Iterable[Column], keep: Column | None = None
) -> DataFrame:
    """One row per island. Groups already sit together by entity, so this adds no shuffle."""
    summary = rows.groupBy(*keys).agg(*aggregates)
    return summary if keep is None else summary.filter(keep)
