"""Monthly usage against the month before.

All jobs roll events up to one row per customer (or product) and month first, so what a window
holds per customer is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import flag, percent_change
from chronoloom.operators.lookup import lookup_join
from chronoloom.operators.periods import monthly_rollup
from chronoloom.operators.rolling import drop_vs_prev, recovery_vs_prev
from chronoloom.operators.sequence import with_prev
from chronoloom.operators.timeline import Timeline
from chronoloom.plans._common import report

MONTH, NOW, PREVIOUS = "month_start", "eventos_mes", "eventos_mes_anterior"


def _monthly_counts(events: DataFrame, key: str, ts: str) -> DataFrame:
    return monthly_rollup(events, [key], ts, [F.count(F.lit(1)).alias(NOW)])


def _with_previous_month(monthly: DataFrame, keys: Iterable[str]) -> Timeline:
    return with_prev(Timeline.bounded(monthly, keys, [MONTH]), {PREVIOUS: NOW})


def feature_drop(
    events: DataFrame, *, key: str = "customer_id", ts: str = "event_time",
    feature: str = "feature_name", valued: str = "export",
    drop: float = 0.30, recovery: float = 0.80, ordered: bool = False,
) -> DataFrame:
    """Monthly use of the valued feature: churn at a fall to ``drop`` of the month before or
    less, recovered at ``recovery`` of it or more."""
    monthly = _monthly_counts(events.filter(F.col(feature) == valued), key, ts)
    found = _with_previous_month(monthly, [key]).with_columns(
        {
            "flag_churn": drop_vs_prev(NOW, PREVIOUS, drop),
            "flag_reativado": recovery_vs_prev(NOW, PREVIOUS, recovery),
        }
    )
    return report(found.rows(), [key, MONTH], ordered)


def feature_drop_cross(
    events: DataFrame, *, key: str = "customer_id", ts: str = "event_time",
    feature: str = "feature_name", valued: str = "export", crossed: str = "upload",
    drop: float = 0.70, recovery: float = 0.80, ordered: bool = False,
) -> DataFrame:
    """As ``feature_drop``; a customer's use of the crossed feature in the month also counts as
    churn, and its use in the previous valued month as recovered."""
    monthly = monthly_rollup(
        events.filter(F.col(feature).isin(valued, crossed)),
        [key],
        ts,
        [
            F.count_if(F.col(feature) == valued).alias(NOW),
            F.max(F.col(feature) == crossed).alias("_crossed"),
        ],
    )
    line = Timeline.bounded(monthly.filter(F.col(NOW) > 0), [key], [MONTH])
    line = with_prev(line, {PREVIOUS: NOW, "_was_crossed": "_crossed"})
    found = line.with_columns(
        {
            "flag_churn": F.greatest(
                drop_vs_prev(NOW, PREVIOUS, drop), flag(F.col("_crossed"))
            ),
            "flag_reativado": F.greatest(
                recovery_vs_prev(NOW, PREVIOUS, recovery), flag(F.col("_was_crossed"))
            ),
        }
    )
    return report(found.rows().drop("_crossed", "_was_crossed"), [key, MONTH], ordered)


def _drop_runs(
    monthly: DataFrame, key: str, drop: float, total: str, counted: Column
) -> Timeline:
    """Drop flag, start of a run of drops, and a running total of the counted months."""
    line = _with_previous_month(monthly, [key]).with_columns(
        {"flag_evento": drop_vs_prev(NOW, PREVIOUS, drop, positive_only=False)}
    )
    line = with_prev(line, {"_flag_before": "flag_evento"})
    line = line.with_columns(
        {
            "inicio_periodo": flag(
                (F.col("flag_evento") == 1) & (F.coalesce("_flag_before", F.lit(0)) == 0)
            )
        }
    )
    return line.running({total: ("sum", F.when(counted, F.col(NOW)).otherwise(0), "rows")})


def usage_drop_run(
    monthly: DataFrame, *, key: str = "customer_id", drop: float = 0.7, ordered: bool = False
) -> DataFrame:
    """Runs of months at ``drop`` or less of the month before, with the events in such months
    added up. Input has one row per customer and month (month_start, eventos_mes)."""
    line = _drop_runs(
        monthly.select(key, MONTH, NOW), key, drop, "eventos_periodo", F.col("flag_evento") == 1
    )
    return report(line.rows().drop("_flag_before"), [key, MONTH], ordered)


def usage_drop_run_raw(
    events: DataFrame, *, key: str = "customer_id", ts: str = "event_date", drop: float = 0.7,
    ordered: bool = False,
) -> DataFrame:
    """``usage_drop_run`` from single events."""
    line = _drop_runs(
        _monthly_counts(events, key, ts), key, drop, "uso_acumulado_periodo",
        F.col("flag_evento") == 1,
    )
    return report(line.rows().drop("_flag_before"), [key, MONTH], ordered)


def usage_drop_severe(
    events: DataFrame, *, key: str = "customer_id", ts: str = "event_date", drop: float = 0.6,
    severe: float = 0.1, ordered: bool = False,
) -> DataFrame:
    """Runs of drops where only months that follow a month without a drop are added up (never
    the first known month), and severe drops are flagged."""
    line = _drop_runs(
        _monthly_counts(events, key, ts), key, drop, "uso_acumulado_periodo",
        (F.col("flag_evento") == 1) & (F.col("_flag_before") == 0),
    )
    found = line.with_columns(
        {
            "flag_reativacao": flag(
                (F.col("flag_evento") == 1) & (F.col(NOW) <= F.col(PREVIOUS) * severe)
            )
        }
    )
    return report(found.rows().drop("_flag_before"), [key, MONTH], ordered)


def product_usage_risk(
    customers: DataFrame, usage: DataFrame, products: DataFrame, *, drop: float = 0.6
) -> DataFrame:
    """Use per customer, product and month against the month before. Customers without use keep
    one row with NULLs, and use of products that are not listed counts for the NULL product.

    Input: customers (customer_id), usage (customer_id, product_id, usage_date, usage_count),
    products (product_id). Use is rolled up before the joins, which then meet months instead of
    single records.
    """
    used = monthly_rollup(
        usage, ["customer_id", "product_id"], "usage_date",
        [F.sum("usage_count").alias("_used")],
    )
    # Products listed twice count twice, and so do customers.
    sold = products.groupBy(F.col("product_id").alias("_product")).agg(
        F.count(F.lit(1)).alias("_times")
    )
    amount = F.col("_used") * F.coalesce("_times", F.lit(1))
    monthly = (
        lookup_join(used, sold, {"product_id": "_product"})
        .groupBy("customer_id", F.col("_product").alias("product_id"), MONTH)
        .agg(F.sum(amount).alias(NOW))
    )
    listed = customers.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_listed"))
    per_customer = listed.join(monthly, "customer_id", "left").select(
        "customer_id", "product_id", MONTH, (F.col(NOW) * F.col("_listed")).alias(NOW)
    )
    line = _with_previous_month(per_customer, ["customer_id", "product_id"])
    return line.rows().select(
        "customer_id",
        "product_id",
        MONTH,
        F.col(NOW).alias("uso_mes"),
        F.col(PREVIOUS).alias("uso_mes_anterior"),
        percent_change(F.col(NOW), F.col(PREVIOUS)).alias("pct_variacao"),
        drop_vs_prev(NOW, PREVIOUS, drop).alias("flag_risco"),
    )
