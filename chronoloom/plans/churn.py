"""Churn and return of customers, from gaps between events or from the months they were active."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import flag
from chronoloom.operators import periods
from chronoloom.operators.sequence import inactivity_intervals
from chronoloom.plans._common import report


def churn_recency(
    events: DataFrame, *, key: str = "customer_id", ts: str = "event_time",
    only: Column | None = None, limit_days: int = 30,
) -> DataFrame:
    """Last event per customer, days from it to the end of the last month, and churn beyond
    ``limit_days``. ``only`` restricts the customers' events (to purchases, say), not the
    reference date."""
    reference = events.select(periods.month_end(F.max(ts))).scalar()
    kept = events if only is None else events.filter(only)
    last = periods.recency(
        kept, key, ts, "ultima_data_compra", "dias_sem_compra", reference=reference
    )
    return last.withColumn("flag_churn", flag(F.col("dias_sem_compra") > limit_days))


def churn_gap_episodes(
    events: DataFrame, *, key: str = "customer_id", ts: str = "event_date",
    tie: Iterable[str] = (), days: int = 30, ordered: bool = False,
) -> DataFrame:
    """Pauses of at least ``days`` days: start, the day it became churn, length, and whether the
    return came later than that day."""
    pauses = inactivity_intervals(
        events, key, ts, tie,
        began="data_inicio_inatividade", resumed="data_retorno", days="dias_sem_atividade",
    ).filter(F.col("dias_sem_atividade") >= days)
    found = pauses.select(
        key,
        "data_inicio_inatividade",
        F.date_add("data_inicio_inatividade", days).alias("data_churn"),
        "dias_sem_atividade",
        F.lit(1).alias("flag_churn"),
        flag(F.col("dias_sem_atividade") > days).alias("flag_reativado"),
    )
    return report(found, [key, "data_churn"], ordered)


def churn_gap_reactivation(
    events: DataFrame, *, key: str = "customer_id", ts: str = "event_time",
    tie: Iterable[str] = (), days: int = 30, ordered: bool = False,
) -> DataFrame:
    """Pauses of at least ``days`` days; returned for good if a further event follows."""
    pauses = inactivity_intervals(
        events, key, ts, tie,
        began="inicio_inatividade", resumed="evento_churn", days="dias_sem_atividade",
        following="data_reativacao",
    ).filter(F.col("dias_sem_atividade") >= days)
    found = pauses.select(
        key,
        "inicio_inatividade",
        "evento_churn",
        F.date_add("inicio_inatividade", days).alias("data_churn"),
        "dias_sem_atividade",
        F.lit(1).alias("flag_churn"),
        flag(F.col("data_reativacao").isNotNull()).alias("flag_reativado"),
        "data_reativacao",
    )
    return report(found, [key, "evento_churn"], ordered)


def calendar_churn(
    events: DataFrame, *, key: str = "customer_id", ts: str = "event_date", ordered: bool = False
) -> DataFrame:
    """Every customer in every month of the data: active or not, and churn in the first month
    without activity."""
    grid = periods.calendar_spine(events, key, ts, scope="global")
    found = grid.select(
        key,
        "month_start",
        F.col("active").alias("ativo"),
        F.col("left").alias("churn"),
    )
    return report(found, [key, "month_start"], ordered)


def customer_calendar(
    events: DataFrame, *, key: str = "customer_id", ts: str = "event_time", ordered: bool = False
) -> DataFrame:
    """Every month from a customer's first to last active one."""
    grid = periods.calendar_spine(events, key, ts, scope="entity")
    return report(grid.select(key, "month_start"), [key, "month_start"], ordered)
