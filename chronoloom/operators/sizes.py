"""Sizes of groups, counted before deciding how to work on them."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS_CONF = "spark.chronoloom.hotRows"
HOT_ROWS_DEFAULT = 20_000_000
TASK_ROWS_CONF = "spark.chronoloom.taskRows"
TASK_ROWS_DEFAULT = 1_000_000


def hot_row_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def hot_groups(df: DataFrame, part: Iterable[str]) -> list:
    """Groups with more rows than the limit, with their sizes; at most all rows / limit of them."""
    return (
        df.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > hot_row_limit(df.sparkSession))
        .collect()
    )


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of ``rows`` rows, dealt by ``keys`` into partitions of about
    ``spark.chronoloom.taskRows`` rows, so that what a task holds does not grow with the table.
    Left alone where the session's number of shuffle partitions is enough for that."""
    spark = df.sparkSession
    wanted = math.ceil(rows / int(spark.conf.get(TASK_ROWS_CONF, str(TASK_ROWS_DEFAULT))))
    if wanted <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(wanted, *keys)
