from chronoloom.functions.timeops import (
    boundary_diff,
    day_diff,
    inclusive_days,
    month_end,
    month_start,
    weekday_number,
)
from chronoloom.functions.values import as_doubles, flag, percent_change, ratio

__all__ = [
    "as_doubles",
    "boundary_diff",
    "day_diff",
    "flag",
    "inclusive_days",
    "month_end",
    "month_start",
    "percent_change",
    "ratio",
    "weekday_number",
]
