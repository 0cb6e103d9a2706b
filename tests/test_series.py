"""Stretches of a series without a key against a plain walk over it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import flag
from chronoloom.operators.series import split_series


def walked(rows, limit):
    """Numbers by all starts up to a row's time; the smallest time is that of unknown times."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    starts, before = [], None
    for t, _, v in ordered:
        starts.append(int(v is not None and before is not None and v - before > limit))
        before = v
    groups: dict = {}
    for n, (t, i, v) in enumerate(ordered):
        number = sum(s for s, r in zip(starts, ordered) if r[0] == t or ordered.index(r) <= n)
        groups.setdefault(number, []).append((t, v))
    return {
        g: (min((t for t, _ in x if t is not None), default=None), max((t for t, _ in x if t is not None), default=None),
            min((v for _, v in x if v is not None), default=None), len(x))
        for g, x in groups.items()
    }


def split(spark, rows, limit, parts=5):
    df = spark.createDataFrame(rows, "t int, i int, v double").repartition(parts)
    found = split_series(
        df, ["t", "i"], "v", lambda now, before: flag(now - before > limit),
        {"low": ("min", F.col("t")), "high": ("max", F.col("t")), "least": ("min", F.col("v")), "n": ("sum", F.lit(1))},
    )
    return {r.grupo_id: (r.low, r.high, r.least, r.n) for r in found.collect()}


@pytest.mark.parametrize("times", [3, 40, 1000], ids=["few times", "some", "many times"])
def test_random_series(spark, times):
    chance = random.Random(times)
    for size in (1, 60, 300):
        rows = [
            (chance.choice([None, *range(times)]) if chance.random() < 0.1 else chance.randrange(times), i,
             None if chance.random() < 0.05 else round(chance.uniform(0, 4), 2))
            for i in range(size)
        ]
        assert split(spark, rows, 1.5) == walked(rows, 1.5)


def test_one_time_and_empty_series(spark):
    rows = [(7, i, float(i * 2 % 6)) for i in range(200)]
    assert split(spark, rows, 1.5) == walked(rows, 1.5)
    df = spark.createDataFrame([], "t int, i int, v double")
    empty = split_series(df, ["t", "i"], "v", lambda a, b: flag(a > b), {"n": ("sum", F.lit(1))})
    assert empty.count() == 0

