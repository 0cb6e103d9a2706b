"""The physical plans stay what they were designed to be."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from chronoloom import registry
from chronoloom.operators import lookup, validity
from chronoloom.operators.sizes import HOT_ROWS_CONF, TASK_ROWS_CONF
from chronoloom.operators.timeline import SLICE, Timeline
from chronoloom.plans import churn, contracts, customers, delivery, instability, orders, usage

QUERIES = registry.queries()
ONE_SHUFFLE = [
    "churn_gap_episodes",
    "churn_gap_reactivation",
    "customer_calendar",
    "terminal_instability",
    "node_instability",
    "device_irregular",
    "sensor_drift",
    "energy_anomaly",
    "job_degraded",
    "job_span",
    "job_degraded_loose",
    "warehouse_billing_delay",
    "hub_prep_delay",
    "driver_sla_streak",
    "metrics_rollup",
]


def plan(capsys, df) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ONE_SHUFFLE)
def test_one_shuffle_by_the_entity(spark, small, capsys, name):
    text = plan(capsys, QUERIES[name](spark, small))
    assert text.count("Exchange hashpartitioning") == 1
    assert "rangepartitioning" not in text and "SinglePartition" not in text
    assert text.count("Sort [") <= 1 and "Join" not in text


def test_no_cross_joins_and_no_python_in_any_query(spark, small, capsys):
    for name, query in QUERIES.items():
        text = plan(capsys, query(spark, small))
        for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "InPandas"):
            assert operator not in text, (name, operator)


def test_scans_read_only_needed_columns(spark, small, capsys):
    text = plan(capsys, QUERIES["energy_anomaly"](spark, small))
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"event_id", "ts", "user_id", "value"}


def test_filters_reach_the_scan(spark, small, capsys):
    text = plan(capsys, QUERIES["subscription_churn_risk"](spark, small))
    assert "EqualTo(o_orderstatus,F)" in text


def test_duplicates_are_limited_before_the_shuffle(spark, small, capsys):
    text = plan(capsys, QUERIES["resolved_logs"](spark, small))
    assert re.search(r"WindowGroupLimit.*row_number\(\), 1, Partial", text)


def test_facts_are_not_shuffled_for_few_versions(spark, small, capsys, monkeypatch):
    facts = "Exchange hashpartitioning(customer_id"
    few = plan(capsys, QUERIES["resolved_logs"](spark, small))
    assert "BroadcastHashJoin" in few and facts not in few
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = plan(capsys, QUERIES["resolved_logs"](spark, small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in many and facts in many


def test_large_group_is_spread_over_tasks(spark):
    """A group with most rows: no window partition holds more than a small part of it."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 100).otherwise(-1).alias("k"),
        # Half of the rows within one hundredth of the time.
        F.when(F.col("id") % 2 == 0, F.col("id") * 100).otherwise(F.col("id")).alias("t"),
    )
    spark.conf.set(HOT_ROWS_CONF, "8000")
    try:
        line = Timeline.measured(df, ["k"], ["t"])
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert line.sliced
    largest = line.df.groupBy("k", SLICE).count().agg(F.max("count")).first()[0]
    assert largest <= 8000
    assert line.rows().count() == 40_000


def test_stacked_steps_read_large_groups_a_few_times(spark, small, capsys):
    spark.conf.set(HOT_ROWS_CONF, "5")
    try:
        found = QUERIES["order_acceleration_panel"](spark, small)
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    text = plan(capsys, found)
    assert text.count("orders.parquet") <= 4
    assert "CartesianProduct" not in text


def test_no_exchange_on_a_large_group_alone(spark, capsys):
    df = spark.range(400).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    spark.conf.set(HOT_ROWS_CONF, "50")
    try:
        line = Timeline.measured(df, ["k"], ["t"]).totals({"whole": F.sum("t")})
        text = plan(capsys, line.large)
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    # The only rows dealt by the key are partial sums, one per group and task.
    for exchange in re.finditer(r"Exchange hashpartitioning\(k#\d+L, \d+\).*\n.*", text):
        assert "partial_sum" in exchange.group(0)


@pytest.mark.parametrize("limit", ["20000000", "400"])
def test_a_series_without_a_key_is_never_in_one_task(spark, small, capsys, limit):
    spark.conf.set(HOT_ROWS_CONF, limit)
    try:
        text = plan(capsys, QUERIES["temperature_jumps"](spark, small))
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    # What meets in one task is one row per range.
    assert "SinglePartition" in text
    for below in text.split("Exchange SinglePartition")[1:]:
        assert "Aggregate(keys=[_range" in "".join(below.splitlines()[:8])


def test_slices_depend_on_rows_alone(spark):
    df = spark.range(500).select(
        F.lit(1).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 40).alias("t"), "id"
    )
    spark.conf.set(HOT_ROWS_CONF, "50")
    try:
        for order in (["t", "id"], ["-t", "id"], ["t", "-id"]):
            one = Timeline.measured(df, ["k"], order).df
            other = Timeline.measured(df.repartition(7), ["k"], order).df
            assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
            assert one.groupBy(SLICE).count().agg(F.max("count")).first()[0] <= 50
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


def test_every_report_can_be_ordered(spark, small, capsys, monkeypatch):
    used = []

    def ordered(df, order, _):
        used.append((tuple(order), df.orderBy(*order)))
        return used[-1][1]

    for module in (churn, contracts, customers, delivery, instability, orders, usage):
        monkeypatch.setattr(module, "report", ordered)
    for name, query in QUERIES.items():
        query(spark, small)
    assert len(used) > 10
    for order, found in used:
        # Ascending, unknown keys first: the sequence of the sorted reports.
        keys = [tuple((v is not None, v) for v in r) for r in found.select(*order).collect()]
        assert keys == sorted(keys), order
    found = QUERIES["calendar_churn"](spark, small)
    assert "rangepartitioning(customer_id" in plan(capsys, found)
    keys = [(r.customer_id, r.month_start) for r in found.collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("name", ["brand_metrics", "brand_checks_ticket", "brand_checks_flags"])
def test_brand_tasks_do_not_grow_with_the_lines(spark, small, monkeypatch, capsys, name):
    before = sorted(map(repr, QUERIES[name](spark, small).collect()))
    monkeypatch.setattr("chronoloom.operators.lookup.BROADCAST_ROWS", 10)
    monkeypatch.setattr("chronoloom.sources.inputs.BROADCAST_ROWS", 10)
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    spark.conf.set(TASK_ROWS_CONF, str(lines // 9))
    try:
        found = QUERIES[name](spark, small)
        text = plan(capsys, found)
        assert sorted(map(repr, found.collect())) == before
    finally:
        spark.conf.unset(TASK_ROWS_CONF)
    # Orders, parts and sales: no task of these stages gets more than its share of the lines.
    wanted = -(-lines // (lines // 9))
    for keys in ("l_orderkey", "l_partkey", "id_cliente#.*marca#.*ano#.*mes#.*id_venda"):
        dealt = re.findall(rf"hashpartitioning\({keys}#?[^)]*, (\d+)\)", text)
        assert dealt and set(map(int, dealt)) == {wanted}, (keys, dealt)


@pytest.mark.parametrize("name", ["license_usage", "resolved_logs", "contract_billing"])
def test_the_ends_of_time_are_read_without_a_join(spark, small, monkeypatch, capsys, name):
    seen = []
    blocks = validity._blocks

    def noted(facts, at):
        seen.append(plan(capsys, facts.select(at)))
        return blocks(facts, at)

    monkeypatch.setattr(validity, "_blocks", noted)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 10)
    text = plan(capsys, QUERIES[name](spark, small))
    assert seen and all("Exchange" not in t and "Join" not in t for t in seen)
    # No shuffle carries the block of a fact: it is worked out from the time.
    assert "_block#" not in text.replace("_span_block#", "")
