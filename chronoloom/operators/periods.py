"""Monthly rollups, calendars and recency."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import day_diff, flag, month_end, month_start


def monthly_rollup(
    df: DataFrame, keys: Iterable[str], ts: str, aggregates: Iterable[Column],
    month: str = "month_start",
) -> DataFrame:
    """Aggregate per key and calendar month."""
    return df.groupBy(*keys, month_start(ts).alias(month)).agg(*aggregates)


def activity_runs(df: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key with ``_runs``, its stretches of consecutive months with a row in order,
    each with its first and last month (``from``, ``to``). Keys without any known time have none.

    A key's months are gathered as a set, one small entry per calendar month that combines before
    the shuffle; a run is as long as it likes and still one entry.
    """
    months = df.select(key, month_start(ts).alias("_month"))
    active = months.groupBy(key).agg(F.array_sort(F.collect_set("_month")).alias("_months"))
    held = F.col("_months")
    opens = F.filter(
        held, lambda m, i: F.coalesce(F.get(held, i - 1) != F.add_months(m, -1), F.lit(True))
    )
    closes = F.filter(
        held, lambda m, i: F.coalesce(F.get(held, i + 1) != F.add_months(m, 1), F.lit(True))
    )
    pairs = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    return active.select(key, pairs.alias("_runs"))


def calendar_spine(
    df: DataFrame, key: str, ts: str, scope: str = "entity", month: str = "month_start"
) -> DataFrame:
    """Every month for every key, with ``active`` telling whether the key had a row in it and
    ``left`` whether it is the first month without one after a stretch with some.

    Scope ``entity`` runs from the first to the last month of the key, ``global`` from the first
    to the last month of the data. Stretches with and without activity follow from the ends of the
    runs; single months are made of them in the last projection, so the dense grid is neither
    shuffled nor joined, and no row is looked up in a set.
    """
    if scope not in ("entity", "global"):
        raise ValueError(f"scope must be entity or global, not {scope!r}")
    runs, found = activity_runs(df, key, ts), F.col("_runs")
    if scope == "entity":
        low, high = F.get(found, 0)["from"], F.element_at(found, -1)["to"]
        runs = runs.filter(F.size("_runs") > 0)
    else:
        # The months of the first and the last time, which need no set of months.
        low = df.select(month_start(F.min(ts))).scalar()
        high = df.select(month_start(F.max(ts))).scalar()

    def stretch(first: Column, last: Column, active: int, left: int) -> Column:
        return F.struct(
            first.alias("from"), last.alias("to"), F.lit(active).alias("active"),
            F.lit(left).alias("left"),
        )

    after = F.transform(found, lambda r, i: stretch(
        F.add_months(r["to"], 1),
        F.coalesce(F.add_months(F.get(found, i + 1)["from"], -1), F.col("_high")), 0, 1,
    ))
    before = stretch(
        F.col("_low"),
        F.coalesce(F.add_months(F.get(found, 0)["from"], -1), F.col("_high")), 0, 0,
    )
    within = F.transform(found, lambda r: stretch(r["from"], r["to"], 1, 0))
    stretches = F.filter(
        F.concat(F.array(before), within, after), lambda x: x["from"] <= x["to"]
    )
    months = F.sequence(F.col("_part.from"), F.col("_part.to"), F.expr("interval 1 month"))
    return (
        runs.withColumns({"_low": low, "_high": high})
        .select(key, F.explode(stretches).alias("_part"))
        .select(key, "_part", F.explode(months).alias(month))
        .select(
            key,
            month,
            F.col("_part.active").alias("active"),
            flag((F.col("_part.left") == 1) & (F.col(month) == F.col("_part.from"))).alias("left"),
        )
    )


def recency(
    df: DataFrame, key: str, ts: str, last: str, days: str, reference: Column | None = None
) -> DataFrame:
    """Last time per key and days from it to a reference date, by default the end of the last
    month in the data."""
    if reference is None:
        reference = df.select(month_end(F.max(ts))).scalar()
    return (
        df.groupBy(key)
        .agg(F.max(ts).alias(last))
        .withColumn(days, day_diff(F.col(last), reference))
    )
