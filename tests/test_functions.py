from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import (
    as_doubles,
    boundary_diff,
    day_diff,
    flag,
    inclusive_days,
    month_end,
    month_start,
    percent_change,
    ratio,
    weekday_number,
)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def ts(text, kind="timestamp_ntz"):
    return F.lit(text).cast(kind)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize(
    ("unit", "a", "b", "expected"),
    [
        ("minute", "2024-01-01 10:00:59", "2024-01-01 10:01:01", 1),
        ("minute", "2024-01-01 10:00:00", "2024-01-01 10:00:59", 0),
        ("minute", "2024-01-01 23:59:00", "2024-01-02 00:01:00", 2),
        ("minute", "2024-01-01 10:01:01", "2024-01-01 10:00:59", -1),
        ("second", "2024-01-01 10:00:00.9", "2024-01-01 10:00:01.1", 1),
        ("second", "2024-02-28 23:59:59", "2024-03-01 00:00:00", 86401),
        ("day", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
        ("day", "2024-01-01 00:00:00", "2024-01-01 23:59:59", 0),
    ],
)
def test_boundary_diff(spark, kind, unit, a, b, expected):
    assert one(spark, boundary_diff(unit, ts(a, kind), ts(b, kind))) == (expected,)


def test_boundary_diff_of_null_and_unknown_unit(spark):
    assert one(spark, boundary_diff("minute", ts(None), ts("2024-01-01"))) == (None,)
    with pytest.raises(ValueError):
        boundary_diff("week", "a", "b")


def test_boundary_diff_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        spring = boundary_diff("minute", ts("2024-03-10 01:30:00"), ts("2024-03-10 03:30:00"))
        assert one(spark, spring) == (120,)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_calendar_expressions(spark):
    at = ts("2024-02-10 13:00:00")
    row = one(
        spark, month_start(at), month_end(at), day_diff(at, month_end(at)), weekday_number(at),
        inclusive_days(F.lit("2024-02-01").cast("date"), F.lit("2024-02-29").cast("date")),
    )
    assert [str(v) for v in row] == ["2024-02-01", "2024-02-29", "19", "7", "29"]


def test_division_rules(spark):
    zero, two, none = F.lit(0), F.lit(2), F.lit(None).cast("int")
    assert one(
        spark, ratio(two, zero), ratio(zero, two), percent_change(two, zero),
        percent_change(two, none), percent_change(F.lit(3), two),
    ) == (None, 0.0, None, None, 50.0)


def test_flag_of_unknown_is_zero(spark):
    assert one(spark, flag(F.lit(None).cast("boolean")), flag(F.lit(True))) == (0, 1)


def test_as_doubles_keeps_other_types(spark):
    df = as_doubles(spark.sql("select cast(1.25 as decimal(9,2)) d, 1 i, 'x' s"))
    assert df.dtypes == [("d", "double"), ("i", "int"), ("s", "string")]
