"""The sliced form of ordered work gives what plain windows give."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.operators.sizes import HOT_ROWS_CONF
from chronoloom.operators.timeline import SLICE, Timeline

SCHEMA = "k bigint, ts timestamp_ntz, id bigint, x bigint"
START = datetime(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame(
        [(k, START + timedelta(minutes=m), i, x) for i, (k, m, x) in enumerate(rows)], SCHEMA
    )


def everything(line: Timeline):
    line = line.neighbours(
        lambda w: {
            "prev": F.lag("x").over(w),
            "prev2": F.lag("id", 2).over(w),
            "next": F.lead("id").over(w),
            "trailing": F.sum("x").over(w.rowsBetween(-5, -1)),
        },
        back=5,
        ahead=1,
    )
    line = line.running(
        {
            "total": ("sum", F.col("x"), "rows"),
            "peers": ("sum", F.lit(1), "range"),
            "highest": ("max", F.col("x"), "before"),
        }
    )
    line = line.totals({"whole": F.sum("x")})
    line = line.reordered(["-x", "id"]).ranks(
        {"place": "row_number", "rank": "rank", "dense": "dense_rank"}
    )
    assert SLICE not in line.rows().columns
    return sorted(map(str, line.rows().select(sorted(line.rows().columns)).collect()))


def both(spark, rows, part, limit):
    df = table(spark, rows)
    plain = everything(Timeline.bounded(df, part, ["ts", "id"]))
    spark.conf.set(HOT_ROWS_CONF, str(limit))
    try:
        line = Timeline.measured(df, part, ["ts", "id"])
        return plain, everything(line), line.sliced
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


@pytest.mark.parametrize("part", [["k"], []])
def test_one_large_group_and_small_ones(spark, part):
    rows = [(1, (i * 7) % 50, i % 9) for i in range(120)]
    rows += [(2, i, None if i % 2 else i) for i in range(5)] + [(None, i, i) for i in range(30)]
    plain, cut, sliced = both(spark, rows, part, 12)
    assert sliced
    assert plain == cut


@settings(
    max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.sampled_from([1, 1, 1, 2, None]),
            st.integers(0, 20),
            st.one_of(st.none(), st.integers(-3, 3)),
        ),
        min_size=15,
        max_size=40,
    )
)
def test_random_tables(spark, rows):
    plain, cut, _ = both(spark, rows, ["k"], 5)
    assert plain == cut


def test_many_rows_with_one_time(spark):
    rows = [(1, 3, i % 4) for i in range(60)] + [(1, i, i) for i in range(8)]
    plain, cut, sliced = both(spark, rows, ["k"], 10)
    assert sliced
    assert plain == cut


def test_rows_with_one_time_are_spread(spark):
    df = table(spark, [(1, 3, 0)] * 200)
    spark.conf.set(HOT_ROWS_CONF, "50")
    try:
        line = Timeline.measured(df, ["k"], ["ts", "id"])
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert line.df.groupBy(SLICE).count().agg(F.max("count")).first()[0] <= 50


def test_small_groups_are_left_alone(spark):
    line = Timeline.measured(table(spark, [(1, 0, 0)]), ["k"], ["ts"])
    assert not line.sliced and SLICE not in line.df.columns


def test_running_sum_over_equal_times(spark):
    df = table(spark, [(1, 0, 1), (1, 0, 1), (1, 5, 1)])
    line = Timeline.bounded(df, ["k"], ["ts", "id"]).running(
        {"by_row": ("sum", F.col("x"), "rows"), "by_time": ("sum", F.col("x"), "range")}
    )
    found = [(r.by_row, r.by_time) for r in line.rows().orderBy("ts", "id").collect()]
    assert found == [(1, 2), (2, 2), (3, 3)]


def test_unknown_frame(spark):
    with pytest.raises(ValueError):
        Timeline.bounded(table(spark, [(1, 0, 0)]), ["k"], ["ts"]).running(
            {"a": ("sum", F.col("x"), "groups")}
        )
