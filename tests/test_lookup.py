from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from chronoloom import registry
from chronoloom.operators import lookup
from chronoloom.operators.lookup import lookup_join
from chronoloom.operators.sizes import HOT_ROWS_CONF, hot_groups


@pytest.fixture
def tables(spark):
    left = spark.range(300).select(
        F.col("id").alias("row"),
        F.when(F.col("id") < 120, 1)
        .when(F.col("id") < 240, F.lit(None).cast("int"))
        .otherwise((F.col("id") % 7).cast("int"))
        .alias("k"),
    )
    right = spark.sql("select * from values (1, 'a'), (2, 'b'), (null, 'n'), (9, 'z') as t(rk, v)")
    return left, right


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize(("broadcast", "hot"), [(100, 1000), (0, 1000), (0, 50)])
def test_all_forms_agree(spark, monkeypatch, tables, null_safe, broadcast, hot):
    left, right = tables
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", broadcast)
    spark.conf.set(HOT_ROWS_CONF, str(hot))
    try:
        found = lookup_join(left, right, {"k": "rk"}, null_safe=null_safe)
        assert found.columns == ["row", "k", "rk", "v"]
        got = {r.row: r.v for r in found.collect()}
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    known = {1: "a", 2: "b", **({None: "n"} if null_safe else {})}
    assert got == {r.row: known.get(r.k) for r in left.collect()}


def test_a_large_key_is_spread(spark, monkeypatch, tables, capsys):
    left, right = tables
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    spark.conf.set(HOT_ROWS_CONF, "50")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.k for r in hot_groups(left, ["k"])} == {1, None}
        lookup_join(left, right, {"k": "rk"}).explain()
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = capsys.readouterr().out
    assert "_salt" in text and "Exchange hashpartitioning(k" in text


def test_sizes_may_come_from_another_table(spark, monkeypatch, tables):
    left, right = tables
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    spark.conf.set(HOT_ROWS_CONF, "50")
    try:
        found = lookup_join(
            left.filter("row % 3 = 0"), right, {"k": "rk"}, sizes_from=left
        )
        assert found.count() == 100
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


@pytest.mark.parametrize("hot", [1000, 50])
def test_a_large_right_side_is_never_broadcast(spark, monkeypatch, tables, capsys, hot):
    left, right = tables
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 3)
    spark.conf.set(HOT_ROWS_CONF, str(hot))
    try:
        # Few bytes by Spark's estimate, so that it would broadcast them by itself.
        lookup_join(left, right, {"k": "rk"}).explain()
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert "SortMergeJoin" in capsys.readouterr().out


@pytest.mark.parametrize(
    "name", ["contract_billing", "price_anomaly", "resolved_claims", "effective_price"]
)
def test_large_version_tables_are_not_broadcast(spark, small, monkeypatch, capsys, name):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 10)
    registry.queries()[name](spark, small).explain()
    text = capsys.readouterr().out
    for join in re.findall(r"BroadcastHashJoin (.*)", text):
        assert not re.search("_span_key|_product|sale_id|partkey|orderkey", join), join
