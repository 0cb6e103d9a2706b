"""One row per key: the first one in a stated order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.timeline import sort_keys


def keep_latest(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """Keep the row that comes first in ``order`` for each key ("-name" means descending).

    Spark limits each key to one row per input task before the shuffle (WindowGroupLimit), so a
    key with very many copies sends one row per task, not all of them.
    """
    best = Window.partitionBy(*keys).orderBy(*sort_keys(order))
    return (
        df.withColumn("_place", F.row_number().over(best))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )
