from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import islands as isl
from chronoloom.operators.timeline import Timeline
from chronoloom.plans import delivery, instability
from chronoloom.sources.inputs import Inputs

START = datetime(2024, 1, 1)


def numbered(spark, rows, policy, limit=5, frame="rows"):
    """(minute, anomalous) rows of one entity -> {minute: island}"""
    df = spark.createDataFrame(
        [(1, START + timedelta(minutes=m), a) for m, a in rows],
        "k int, ts timestamp_ntz, a int",
    )
    line = Timeline.bounded(df, ["k"], ["ts"]).neighbours(
        lambda w: {"t0": F.lag("ts").over(w), "a0": F.lag("a").over(w)}, back=1
    )
    line = line.with_columns({"g": isl.gap_flag("minute", "t0", "ts", limit)})
    line = isl.assign_islands(line, isl.start_flag(policy, "a", "g", "t0", "a0"), frame, "island")
    return {
        int((r.ts - START).total_seconds() // 60): r.island
        for r in line.rows().collect()
        if r.a == 1 or policy == isl.FIRST_OR_GAP
    }


def grouped(islands):
    groups = {}
    for minute, island in islands.items():
        groups.setdefault(island, []).append(minute)
    return sorted(sorted(g) for g in groups.values())


ALTERNATING = [(0, 1), (1, 0), (2, 1), (3, 1), (4, 0), (5, 1)]
# 5 minutes apart is no gap yet, 6 is.
GAPS = [(0, 1), (5, 1), (11, 1), (12, 1)]


@pytest.mark.parametrize("policy", [isl.BREAK, isl.ONSET])
def test_stretches(spark, policy):
    assert grouped(numbered(spark, ALTERNATING, policy)) == [[0], [2, 3], [5]]
    assert grouped(numbered(spark, GAPS, policy)) == [[0, 5], [11, 12]]
    assert grouped(numbered(spark, [(0, 1)], policy)) == [[0]]
    assert grouped(numbered(spark, [(0, 0), (1, 1)], policy)) == [[1]]


def test_numbers_differ_between_policies(spark):
    assert numbered(spark, ALTERNATING, isl.BREAK) == {0: 1, 2: 2, 3: 2, 5: 3}
    assert numbered(spark, ALTERNATING, isl.ONSET) == {0: 1, 2: 2, 3: 2, 5: 3}
    assert numbered(spark, [(0, 0), (1, 0), (2, 1)], isl.BREAK) == {2: 2}
    assert numbered(spark, [(0, 0), (1, 0), (2, 1)], isl.ONSET) == {2: 1}


def test_event_opens_at_every_anomalous_row(spark):
    found = numbered(spark, [(0, 1), (1, 1), (2, 0), (3, 1)], isl.EVENT, frame="range")
    assert grouped(found) == [[0], [1], [3]]


def test_first_or_gap_takes_in_normal_rows(spark):
    rows = [(0, 0), (1, 1), (2, 0), (10, 1), (11, 0)]
    assert grouped(numbered(spark, rows, isl.FIRST_OR_GAP)) == [[0, 1, 2], [10, 11]]
    assert numbered(spark, rows, isl.FIRST_OR_GAP)[0] == 0


def test_first_row_may_count_as_no_gap(spark):
    df = spark.sql(
        "select cast(null as timestamp_ntz) t0, timestamp_ntz'2024-01-01 00:00:00' ts"
    )
    row = df.select(
        isl.gap_flag("minute", "t0", "ts", 5), isl.gap_flag("minute", "t0", "ts", 5, False)
    ).first()
    assert tuple(row) == (1, 0)


def test_unknown_policy():
    with pytest.raises(ValueError):
        isl.start_flag("other", "a", "g", "t0", "a0")


def test_break_and_onset_find_the_same_islands(spark, medium):
    def spans(policy):
        found = instability.energy_anomaly(
            Inputs(spark, medium).readings(), entity="entity_id", ts="event_time",
            value="reading", tie=["event_id"], gap_minutes=1440, min_minutes=0, policy=policy,
        )
        return found.drop("grupo_id")

    a, b = spans(isl.BREAK), spans(isl.ONSET)
    assert a.count() == 2311
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_islands_of_an_entity_are_disjoint_and_ordered(spark, medium):
    found = instability.sensor_drift(
        Inputs(spark, medium).readings(), entity="entity_id", ts="event_time", tie=["event_id"],
        gap_seconds=86400, min_seconds=0,
    )
    line = Timeline.bounded(found, ["entity_id"], ["grupo_id"]).neighbours(
        lambda w: {"before": F.lag("fim").over(w)}, back=1
    )
    assert line.rows().filter(F.col("before") >= F.col("inicio")).isEmpty()


def test_event_policy_with_its_own_duration_filter_is_empty(spark, small):
    found = instability.node_instability(
        Inputs(spark, small).readings(), entity="entity_id", ts="event_time",
        latency="reading", tie=["event_id"],
    )
    assert found.isEmpty()


def delays(spark, job, rows, **more):
    df = spark.createDataFrame(
        [
            (i, 1, START + timedelta(minutes=m), None if d is None
             else START + timedelta(minutes=m + d), 1)
            for i, (m, d) in enumerate(rows)
        ],
        "order_id int, hub_id int, payment_at timestamp_ntz, done timestamp_ntz, "
        "priority_flag int",
    )
    return job(df, entity="hub_id", min_minutes=0, min_orders=1, **more)


def test_order_without_invoice_does_not_end_a_billing_delay(spark):
    rows = [(0, 200), (10, None), (20, 200)]
    billing = delays(spark, delivery.warehouse_billing_delay, rows, invoiced="done")
    assert [r.qnt_pedidos for r in billing.collect()] == [2]
    prep = delays(spark, delivery.hub_prep_delay, rows, packed="done")
    assert [r.qtd_pedidos for r in prep.collect()] == [1, 1]


def test_ordered_report(spark, small):
    found = instability.job_span(
        Inputs(spark, small).readings(), entity="entity_id", ordered=True
    )
    ids = [r.entity_id for r in found.collect()]
    assert ids == sorted(ids) and ids
