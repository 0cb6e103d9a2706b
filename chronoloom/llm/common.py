"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.storage import shared_folder, stored  # noqa: F401

# Between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[ \t-\r]+"


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the wanted ones that clash with none of ``df``'s, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        candidate, n = f"_{name}", 0
        while candidate.lower() in taken:
            n += 1
            candidate = f"_{name}{n}"
        taken.add(candidate.lower())
        found.append(candidate)
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null or blank texts."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that its lineage ends there and a lost
    executor costs a read."""
    return stored(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
