"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from chronoloom import oracle, registry
from chronoloom.operators.sizes import HOT_ROWS_CONF
from compare import difference, duck

QUERIES = registry.queries()
ORACLE = oracle.oracle_sql()
# Contradictions between flags and figures: none is what the check should find.
EMPTY = {"brand_checks_flags"}
# Jobs that look along the rows of an entity, in the sliced form too.
ROW_LEVEL = [
    "churn_gap_episodes",
    "churn_gap_reactivation",
    "customer_360",
    "temperature_jumps",
    "terminal_instability",
    "node_instability",
    "device_irregular",
    "sensor_drift",
    "energy_anomaly",
    "job_degraded",
    "job_degraded_loose",
    "warehouse_billing_delay",
    "hub_prep_delay",
    "driver_sla_streak",
    "delivery_sla_panel",
    "driver_slowing",
    "order_deceleration",
    "order_acceleration_panel",
]


@pytest.fixture(scope="module")
def medium_duck(medium):
    return duck(medium)


@pytest.fixture(scope="module")
def small_duck(small):
    return duck(small)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry_runs(spark):
    assert contract.entry(spark).columns == [
        "entity_id", "grupo_id", "inicio", "fim", "duracao", "qtd_leituras",
    ]


@pytest.mark.parametrize("name", QUERIES)
def test_matches_oracle(spark, medium, medium_duck, name):
    assert difference(QUERIES[name](spark, medium), ORACLE[name], medium_duck) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EMPTY))
def test_oracle_finds_rows(medium_duck, name):
    assert medium_duck.execute(f"SELECT count(*) FROM ({ORACLE[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_matches_oracle_with_large_groups(spark, small, small_duck, name):
    limit = "5" if name.startswith("order_") else "40"
    spark.conf.set(HOT_ROWS_CONF, limit)
    try:
        assert difference(QUERIES[name](spark, small), ORACLE[name], small_duck) is None
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


def test_types_match_oracle(spark, small, small_duck):
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    }
    for name, query in QUERIES.items():
        ours = {c: names[t] for c, t in query(spark, small).dtypes}
        theirs = {
            r[0]: r[1] for r in small_duck.execute(f"DESCRIBE {ORACLE[name]}").fetchall()
        }
        assert ours == theirs, name
