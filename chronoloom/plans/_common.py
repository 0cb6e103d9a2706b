from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def report(df: DataFrame, order: Iterable[str], ordered: bool) -> DataFrame:
    return df.orderBy(*order) if ordered else df
