"""Left joins to a table with one row per key that stand a key holding much of the left side."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.sizes import hot_groups, hot_row_limit

# Rows a table may have, by count, to be sent to every executor.
BROADCAST_ROWS = 200_000


def sorted_if_large(right: DataFrame, rows: int) -> DataFrame:
    """``right`` as a join should take it: sent to every executor up to BROADCAST_ROWS rows, else
    shuffled and sorted. Left to itself Spark goes by the bytes of the files below, which say little
    about rows that were exploded or gathered on the way, and would send a large table through the
    driver."""
    return F.broadcast(right) if rows <= BROADCAST_ROWS else right.hint("merge")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    *,
    right_rows: int | None = None,
    also: Column | None = None,
    null_safe: bool = False,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """``left`` with the columns of its ``right`` row; ``on`` maps left to right key columns.

    A right side of at most BROADCAST_ROWS rows (counted unless ``right_rows`` gives a bound) is
    broadcast, and the left rows stay where they are. Otherwise both are shuffled by key and sorted,
    whatever size Spark estimates; left keys with more rows than ``spark.chronoloom.hotRows`` are first found and spread over salts,
    with their right rows repeated per salt. ``sizes_from`` is a cheaper table to count them in,
    with at least as many rows per key.
    """
    if right_rows is None:
        right_rows = right.limit(BROADCAST_ROWS + 1).count()
    condition = F.lit(True) if also is None else also
    for a, b in on.items():
        pair = F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b)
        condition = condition & pair
    if right_rows <= BROADCAST_ROWS:
        return left.join(sorted_if_large(right, right_rows), condition, "left")
    keys = list(on)
    hot = hot_groups(left if sizes_from is None else sizes_from, keys)
    if not hot:
        return left.join(sorted_if_large(right, right_rows), condition, "left")
    limit = hot_row_limit(left.sparkSession)
    spread = F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int")
    salted = _with_salts(left, hot, {k: k for k in keys}, limit).withColumn("_salt", spread)
    repeated = _with_salts(right, hot, on, limit).withColumn(
        "_right_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    )
    return salted.drop("_salts").join(
        sorted_if_large(repeated.drop("_salts"), right_rows),
        condition & (F.col("_salt") == F.col("_right_salt")),
        "left",
    ).drop("_salt", "_right_salt")


def _with_salts(df: DataFrame, hot: list, columns: Mapping[str, str], limit: int) -> DataFrame:
    """Add ``_salts``: 1, or for a listed key as many as its size asks for.

    At most all rows / limit keys are listed, and their salts add up to a few times that.
    """
    names = list(columns)
    schema = T.StructType(
        [T.StructField(f"_hot_{n}", df.schema[c].dataType) for n, c in columns.items()]
        + [T.StructField("_wanted", T.IntegerType())]
    )
    listed = df.sparkSession.createDataFrame(
        [(*(r[n] for n in names), math.ceil(4 * r["_rows"] / limit)) for r in hot], schema
    )
    same = F.lit(True)
    for n, c in columns.items():
        same = same & F.col(c).eqNullSafe(F.col(f"_hot_{n}"))
    return (
        df.join(F.broadcast(listed), same, "left")
        .withColumn("_salts", F.coalesce("_wanted", F.lit(1)))
        .drop("_wanted", *(f"_hot_{n}" for n in names))
    )
