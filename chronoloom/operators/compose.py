"""Combining metric tables and comparing parts with wholes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import ratio
from chronoloom.operators.lookup import lookup_join
from chronoloom.operators.timeline import Timeline


def merge_metrics(
    sources: Iterable[tuple[DataFrame, Mapping[str, Column]]], keys: Iterable[str]
) -> DataFrame:
    """Sum metrics of several fact tables per key and put them side by side.

    The same as aggregating each table and full-outer-joining the results on the keys: a key
    found in only one table has NULL for the others' metrics. The facts are stacked and summed
    once, which takes one shuffle for any number of tables. As in a join, NULL keys of different
    tables do not meet.
    """
    keys = list(keys)
    sources = list(sources)
    names = [name for _, metrics in sources for name in metrics]
    unknown = F.lit(False)
    for k in keys:
        unknown = unknown | F.col(k).isNull()
    stacked = None
    for number, (df, metrics) in enumerate(sources):
        rows = df.select(*keys, *(expr.alias(name) for name, expr in metrics.items()))
        rows = rows.withColumn("_source", F.when(unknown, F.lit(number)))
        stacked = (
            rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
        )
    return (
        stacked.groupBy(*keys, "_source")
        .agg(*(F.sum(name).alias(name) for name in names))
        .drop("_source")
    )


def share_and_rank(
    df: DataFrame, group: Iterable[str], value: str, rank: str, total: str, share: str
) -> DataFrame:
    """Total of a group, each row's percentage of it and its rank by value.

    For groups of bounded size (one row per category); one shuffle serves all three.
    """
    group = list(group)
    whole = Window.partitionBy(*group)
    return df.withColumns(
        {
            total: F.sum(value).over(whole),
            rank: F.rank()
            .over(whole.orderBy(F.col(value).desc_nulls_last()))
            .cast("bigint"),
        }
    ).withColumn(share, ratio(F.col(value), F.col(total)) * 100)


def rank_in_group(
    df: DataFrame, group: Iterable[str], value: str, name: str,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Rank by descending value in groups of any size; ``sizes_from`` as in Timeline.measured."""
    line = Timeline.measured(df, group, [f"-{value}"], sizes_from)
    return line.ranks({name: "rank"}).rows()


def top_category(category: str, amount: str) -> Column:
    """Aggregate: the category with the largest amount, the first by name among equals.

    Unknown amounts come after all known ones.
    """
    value = F.col(amount)
    return F.min_by(category, F.struct(value.isNull(), -value, F.col(category)))


def with_group_totals(
    df: DataFrame,
    group: Iterable[str],
    totals: Mapping[str, Column],
    source: DataFrame | None = None,
) -> DataFrame:
    """Add whole-group aggregates to every row, taken over ``source`` (``df`` by default).

    Aggregated first and looked up, so that a large group is combined before the shuffle; a
    window would put all its rows into one task.
    """
    group = list(group)
    facts = df if source is None else source
    per_group = facts.groupBy(*group).agg(*(expr.alias(n) for n, expr in totals.items()))
    per_group = per_group.select(*(F.col(c).alias(f"_total_{c}") for c in group), *totals)
    found = lookup_join(
        df, per_group, {c: f"_total_{c}" for c in group}, null_safe=True, sizes_from=facts
    )
    return found.drop(*(f"_total_{c}" for c in group))


def resolve_price(price: str, fallback: str) -> Column:
    """The given price, or the fallback where it is missing or not positive."""
    return F.when(F.col(price) > 0, F.col(price)).otherwise(F.col(fallback))


def band_label(value: str, reference: str, low: float, high: float) -> Column:
    """'SUSPEITO' outside low..high times the reference, else 'OK', also when unknown."""
    outside = (F.col(value) < F.col(reference) * low) | (F.col(value) > F.col(reference) * high)
    return F.when(outside, "SUSPEITO").otherwise("OK")


def metrics_rollup(df: DataFrame, dimensions: Iterable[str], measure: str) -> DataFrame:
    """Sum, mean and row count of a measure by dimensions."""
    return (
        df.groupBy(*dimensions)
        .agg(
            F.sum(measure).alias("soma_medida"),
            F.count(measure).alias("_known"),
            F.count(F.lit(1)).alias("qtd"),
        )
        .withColumn("media_medida", ratio(F.col("soma_medida"), F.col("_known")))
        .select(*dimensions, "soma_medida", "media_medida", "qtd")
    )
