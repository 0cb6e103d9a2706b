"""Tables laid out for the jobs that read them: bucketed by entity, or sorted into ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.storage import remove

# A folder that begins with an underscore is none of the table's data to a reader.
_MANIFEST = "_manifest"


def write_by_entity(
    df: DataFrame, table: str, key: str, order: Sequence[str], buckets: int, path: str
) -> DataFrame:
    """``df`` as the table ``table`` at ``path``, bucketed by ``key`` and sorted by it and
    ``order`` within a bucket. Jobs that group or join by ``key`` read it without an exchange.

    Rows are dealt to their buckets before they are written, so that each bucket is one file and
    its order holds. Choose as many buckets as tasks should share the largest job on the table.
    """
    dealt = df.repartition(buckets, key)
    (
        dealt.write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key, *order)
        .option("path", path)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def write_sorted(df: DataFrame, order: Sequence[str], path: str, ranges: int | None = None) -> DataFrame:
    """An ordered report of any size as files: rows are dealt into ranges of ``order`` (ascending,
    unknown values first), each sorted by a task of its own into one file.

    The manifest beside them, which is returned, has one row per file in the report's order:
    ``number``, ``file``, ``rows``, ``first`` and ``last`` (the bounds as structs of the order
    columns).
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).write.parquet(path)
    bound = F.struct(*order)
    files = (
        spark.read.parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min(bound).alias("first"), F.max(bound).alias("last"))
    )
    # One row per file: numbering them all in one task is small. Spark names parts in order.
    ordered = files.orderBy("first", "file").coalesce(1)
    ordered.select(F.monotonically_increasing_id().alias("number"), "*").write.parquet(
        f"{path}/{_MANIFEST}"
    )
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_MANIFEST}")


def _between(low: Column | None, high: Column | None) -> Column:
    found = F.lit(True)
    if low is not None:
        found = found & (F.col("last") >= low)
    if high is not None:
        found = found & (F.col("first") <= high)
    return found


def files_in_order(
    spark: SparkSession, path: str, low: Column | None = None, high: Column | None = None
) -> list[str]:
    """The files of a sorted report in its order; with bounds (structs of the order columns) only
    those that may hold rows between them."""
    kept = manifest(spark, path).filter(_between(low, high))
    return [r.file for r in kept.orderBy("number").select("file").collect()]


def rows_in_order(spark: SparkSession, path: str) -> Iterator[Row]:
    """The rows of a sorted report in its order, file by file, without sorting them again."""
    for file in files_in_order(spark, path):
        yield from spark.read.parquet(file).toLocalIterator()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written report with its manifest."""
    remove(spark, path)
