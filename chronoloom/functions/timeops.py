"""Date and time expressions.

Every function takes column names or Columns and returns a Column. They work on the wall-clock
fields of the value, so TIMESTAMP_NTZ input gives the same answer under any session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_diff(earlier: ColumnLike, later: ColumnLike) -> Column:
    """Calendar days from one value to the other; midnight is the boundary."""
    return F.datediff(F.to_date(_col(later)), F.to_date(_col(earlier))).cast("bigint")


def boundary_diff(unit: str, earlier: ColumnLike, later: ColumnLike) -> Column:
    """Number of unit boundaries crossed, not whole units elapsed.

    From 10:00:59 to 10:01:01 one minute boundary is crossed although two seconds passed.
    """
    a, b = _col(earlier), _col(later)
    days = day_diff(a, b)
    unit = unit.lower()
    if unit == "day":
        return days
    if unit == "minute":
        return days * 1440 + (_minute_of_day(b) - _minute_of_day(a))
    if unit == "second":
        return days * 86400 + (
            (_minute_of_day(b) * 60 + F.second(b)) - (_minute_of_day(a) * 60 + F.second(a))
        )
    raise ValueError(f"unit must be day, minute or second, not {unit!r}")


def _minute_of_day(c: Column) -> Column:
    return F.hour(c) * 60 + F.minute(c)


def month_start(c: ColumnLike) -> Column:
    """First day of the month as a DATE, the month key used everywhere."""
    return F.trunc(_col(c), "month")


def month_end(c: ColumnLike) -> Column:
    """Last day of the month as a DATE."""
    return F.last_day(_col(c))


def inclusive_days(first: ColumnLike, last: ColumnLike) -> Column:
    """Days in a closed date range."""
    return day_diff(first, last) + 1


def weekday_number(c: ColumnLike) -> Column:
    """1 for Sunday through 7 for Saturday."""
    return F.dayofweek(_col(c))
