"""Stretches of one series that has no key, with no task that holds the whole series.

The rows are dealt once into ranges of their order, sorted and written. Each range is folded into
one element per time; what a range must know of the others is one row per range: the last value
before it, the starts counted before it, and those of its last time that lie in later ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.ranges import sorted_ranges

# How partial figures of a stretch are combined.
_MERGE = {"min": F.min, "max": F.max, "sum": F.sum}


def split_series(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    starts: Callable[[Column, Column], Column],
    parts: Mapping[str, tuple[str, Column]],
    name: str = "grupo_id",
) -> DataFrame:
    """One row per stretch of a series: its number and the figures of ``parts``.

    ``order`` names the time and columns that break ties, ascending, unknown values first.
    ``starts`` tells from a row's value and that of the row before (NULL for the first row) whether
    a stretch starts with it, as 0 or 1; rows of one time belong to the stretch that all starts up
    to that time lead to. ``parts`` maps names to (min | max | sum, expression of a row).
    """
    rows = sorted_ranges(df, [F.col(c).asc_nulls_first() for c in order])
    ts = order[0]
    # Both readers below share the exchange of the written rows.
    elements = _elements(rows, ts, value, starts, parts)
    ranges = F.broadcast(_ranges(elements, ts))
    number = F.col("_before") + F.col("_run") + F.when(
        F.col(ts).eqNullSafe(F.col("_last")), F.col("_after")
    ).otherwise(0)
    return (
        elements.join(ranges, F.col("_range") == F.col("_of"))
        .groupBy(number.alias(name))
        .agg(*(_MERGE[kind](F.col(n)).alias(n) for n, (kind, _) in parts.items()))
    )


def _elements(
    rows: DataFrame, ts: str, value: str, starts: Callable[[Column, Column], Column],
    parts: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """One row per range and time: the figures of its rows, their starts, the starts of the range
    up to there (``_run``) and its number in the range."""
    # One row per range, combined where the rows are read.
    borders = rows.groupBy(F.col("_range").alias("_of")).agg(
        F.max_by(value, "_place").alias("_end")
    ).select("_of", F.lag("_end").over(Window.orderBy("_of")).alias("_entry"))
    cell = Window.partitionBy("_range")
    previous = F.when(F.col("_place") == 0, F.col("_entry")).otherwise(
        F.lag(value).over(cell.orderBy("_place"))
    )
    times = cell.orderBy(F.col(ts).asc_nulls_first())
    return (
        rows.join(F.broadcast(borders), F.col("_range") == F.col("_of"))
        .withColumn("_previous", previous)
        .groupBy("_range", ts)
        .agg(
            F.sum(starts(F.col(value), F.col("_previous"))).alias("_starts"),
            *(_MERGE[kind](expr).alias(n) for n, (kind, expr) in parts.items()),
        )
        .withColumns({
            "_run": F.sum("_starts").over(times), "_nth": F.row_number().over(times)
        })
    )


def _ranges(elements: DataFrame, ts: str) -> DataFrame:
    """One row per range: its last time, the starts before it, and the starts of that time in later
    ranges."""
    ends = elements.groupBy(F.col("_range").alias("_of")).agg(
        F.sum("_starts").alias("_total"),
        F.min_by(ts, "_nth").alias("_first"),
        F.max_by(ts, "_nth").alias("_last"),
        F.min_by("_starts", "_nth").alias("_opening"),
    )
    along = Window.orderBy("_of")
    # Starts of a range's first time, with those of all later ranges that begin with it too.
    shared = F.sum("_opening").over(Window.partitionBy("_first").orderBy(F.col("_of").desc()))
    goes_on = F.lead("_of").over(along).isNotNull() & F.lead("_first").over(along).eqNullSafe(
        F.col("_last")
    )
    return ends.withColumn("_shared", shared).select(
        "_of",
        "_last",
        F.coalesce(
            F.sum("_total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.when(goes_on, F.lead("_shared").over(along)).otherwise(0).alias("_after"),
    )
