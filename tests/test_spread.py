"""Islands from summaries of slices that merge equal those of one window per group."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoloom import registry
from chronoloom.operators import islands as isl
from chronoloom.operators.spread import Spread
from chronoloom.operators.timeline import HALO, SLICE
from chronoloom.plans import instability

START = datetime(2024, 1, 1)
SCHEMA = "machine int, at timestamp_ntz, n int, status int, value double, n_ int"


def series(spark, seed, rows=400):
    """One machine holds most rows, some have one; unknown machines, times and values, ties."""
    chance = random.Random(seed)
    found = []
    for n in range(rows):
        machine = chance.choice([1, 1, 1, 1, 1, 1, 2, 3, None, 100 + n])
        at = None if chance.random() < 0.02 else START + timedelta(minutes=chance.randrange(600))
        value = None if chance.random() < 0.05 else float(chance.randrange(1, 12))
        found.append((machine, at, n, chance.choice([0, 0, 1]), value, n))
    return spark.createDataFrame(found, SCHEMA)


def rows(df):
    return sorted(map(repr, df.collect()))


def jobs(policy):
    own = {"entity": "machine", "ts": "at", "tie": ["n"], "gap_minutes": 2, "min_minutes": 0}
    return {
        "energy": lambda df, **x: instability.energy_anomaly(
            df, value="value", rows=3, factor=1.1, policy=policy, **own, **x
        ),
        "terminal": lambda df, **x: instability.terminal_instability(
            df, status="status", latency="value", min_unstable=1, **own, **x
        ),
    }


@pytest.mark.parametrize("policy", [isl.BREAK, isl.ONSET, isl.EVENT, isl.FIRST_OR_GAP])
@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_a_window_per_group(spark, policy, seed):
    df = series(spark, seed)
    for name, job in jobs(policy).items():
        assert rows(job(df, spread=True)) == rows(job(df)), name


@pytest.mark.parametrize("size", [0, 1, 2])
def test_tables_smaller_than_the_slices(spark, size):
    df = series(spark, 3).limit(size)
    for job in jobs(isl.BREAK).values():
        assert rows(job(df, spread=True)) == rows(job(df))


def test_one_island_over_all_slices(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("g"), F.col("id").alias("t"), F.lit(1).alias("a")
    )
    line = Spread.dealt(df, ["g"], ["t"], 1, slices=8)
    line = line.neighbours(lambda w: {"before": F.lag("t").over(w)}, back=1)
    start = F.when(F.col("before").isNull(), 1).otherwise(0)
    parts = {"first": ("min", F.col("t")), "last": ("max", F.col("t")), "n": ("sum", F.lit(1))}
    found = line.islands(start, F.col("a") == 1, parts, "number").collect()
    assert [tuple(r) for r in found] == [(1, 1, 0, 2999, 3000)]


def test_a_large_group_lies_in_many_slices_with_its_halo(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("g"), F.col("id").alias("t")
    )
    held = Spread.dealt(df, ["g"], ["t"], 2, slices=8).df
    own = held.filter(~F.col(HALO)).groupBy(SLICE).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("low")
    ).orderBy(SLICE).collect()
    assert len(own) == 8 and sum(r.n for r in own) == 4000 and max(r.n for r in own) < 1000
    halo = {}
    for r in held.filter(HALO).collect():
        halo.setdefault(r[SLICE], []).append(r.t)
    assert {k: sorted(v) for k, v in halo.items()} == {
        r[SLICE]: [r.low - 2, r.low - 1] for r in own[1:]
    }


def test_rows_are_shuffled_once_and_no_window_spans_a_group(spark, small, capsys):
    df = spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts", "event_id")
    line = Spread.dealt(df, ["user_id"], ["ts", "event_id"], 1)
    line = line.neighbours(lambda w: {"before": F.lag("ts").over(w)}, back=1)
    capsys.readouterr()
    line.df.explain()
    text = capsys.readouterr().out
    for spec in text.split("windowspecdefinition(")[1:]:
        assert spec.startswith(f"{SLICE}#") or spec.startswith(f"{SLICE}#", spec.find(f"{SLICE}#"))
    exchanges = {x.split(", [plan_id")[0] for x in text.split("Exchange hashpartitioning(")[1:]}
    assert all(x.startswith(f"{SLICE}#") for x in exchanges)


def test_registered_forms_agree(spark, small):
    queries = registry.queries()
    for name in ("energy_anomaly", "terminal_instability"):
        assert rows(queries[f"{name}_spread"](spark, small)) == rows(queries[name](spark, small))
