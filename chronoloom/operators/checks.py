"""Reconciliation of a result with a second computation of the same figures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def materialise(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet to a folder the caller names, one that all executors share, and
    read back: a table for several checks on one computation."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def agree(left: Column, right: Column, tolerance: float = TOLERANCE) -> Column:
    """True where two figures are equal up to rounding; unknown figures do not agree."""
    return F.coalesce(F.abs(left - right) <= tolerance, F.lit(False))


def compare_totals(
    parts: DataFrame, whole: DataFrame, keys: Iterable[str], parts_sum: str, whole_sum: str,
    difference: str,
) -> DataFrame:
    """Both totals per key side by side; a key missing on one side shows NULL there."""
    keys = list(keys)
    right = whole.select(*(F.col(k).alias(f"_{k}") for k in keys), whole_sum)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return parts.join(right, same, "full").select(
        *(F.coalesce(k, f"_{k}").alias(k) for k in keys),
        parts_sum,
        whole_sum,
        (F.col(parts_sum) - F.col(whole_sum)).alias(difference),
    )


def violations(df: DataFrame, rules: Iterable[Column]) -> DataFrame:
    """Rows that break at least one rule, a rule being the condition that must not hold."""
    broken = F.lit(False)
    for rule in rules:
        broken = broken | rule
    return df.filter(broken)
