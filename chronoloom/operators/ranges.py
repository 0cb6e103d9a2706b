"""One total order over a table of any size: sorted ranges and what is carried from one to the next.

A window without partitions sorts the whole table in one task. Here rows are dealt into ranges of
the order, each sorted in a task of its own and written; a few numbers per range are then carried
from range to range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.storage import stored

# monotonically_increasing_id numbers rows of a partition from partition * 2^33 on.
_PART_BITS = 33


def sorted_ranges(
    df: DataFrame, order: Sequence[Column], ranges: int | None = None, copies: str | None = None
) -> DataFrame:
    """``df`` in ranges of ``order``, sorted within each, with ``_range`` (the range's number, in
    order) and ``_place`` (the row's, from 0), written so that both are fixed.

    Rows equal in all of ``order`` share a range: end the order with columns that tell rows apart,
    or combine such rows and give the column with their number as ``copies``; they are repeated
    after sorting.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    if copies is not None:
        dealt = dealt.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
        dealt = dealt.drop(copies)
    return stored(
        dealt.withColumn("_range", F.shiftright(number, _PART_BITS).cast("int")).withColumn(
            "_place", number.bitwiseAND(F.lit((1 << _PART_BITS) - 1))
        )
    )


def carried(ranged: DataFrame, amount: Column | None = None) -> DataFrame:
    """(_of, _before): per range the sum of ``amount`` (by default the number of rows) over all
    ranges before it. One row per range, so the window over them all is small."""
    totals = ranged.groupBy(F.col("_range").alias("_of")).agg(
        (F.count(F.lit(1)) if amount is None else F.sum(amount)).alias("_total")
    )
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_of", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))


def numbered(
    df: DataFrame,
    order: Sequence[Column],
    name: str,
    ranges: int | None = None,
    copies: str | None = None,
) -> DataFrame:
    """``df`` with ``name``: each row's number in ``order``, from 1, over the whole table."""
    ranged = sorted_ranges(df, order, ranges, copies)
    # One row per range: as many as there are partitions.
    offsets = F.broadcast(carried(ranged))
    return (
        ranged.join(offsets, F.col("_range") == F.col("_of"))
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_range", "_place", "_of", "_before")
    )
