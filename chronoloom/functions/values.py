"""Small arithmetic and flag expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient; NULL when the divisor is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent of the previous value; NULL when that is zero or missing."""
    return F.try_divide((current - previous).cast("double") * 100.0, previous.cast("double"))


def as_doubles(df: DataFrame) -> DataFrame:
    """Cast decimal columns to double, for results that leave the exact-sum stage."""
    return df.select(
        *(
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )
