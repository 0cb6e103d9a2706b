"""Speeding up and slowing down of a customer's orders.

Input: orders (customer_id, order_date, online_flag, order_id and what else should be kept) and
customers (customer_id, one row each), for the panel also their person_id and people (person_id, one
row each, and names).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import day_diff, flag
from chronoloom.operators.lookup import lookup_join
from chronoloom.operators.sequence import had_before, monotone_run, with_prev
from chronoloom.operators.timeline import Timeline
from chronoloom.plans._common import report


def _with_intervals(
    orders: DataFrame, customers: DataFrame, tie: Iterable[str]
) -> Timeline:
    """Orders of known customers with the days since the order before."""
    listed = customers.withColumnRenamed("customer_id", "_customer")
    known = lookup_join(orders, listed, {"customer_id": "_customer"}, sizes_from=orders).filter(
        F.col("_customer").isNotNull()
    )
    line = Timeline.measured(
        known.drop("_customer"), ["customer_id"], ["order_date", *tie], sizes_from=orders
    )
    return with_prev(line, {"pedido_anterior": "order_date"}).with_columns(
        {"diff_dias_pedidos": day_diff("pedido_anterior", "order_date")}
    )


def order_deceleration(
    orders: DataFrame, customers: DataFrame, *, tie: Iterable[str] = ("order_id",),
    ordered: bool = False,
) -> DataFrame:
    """Online orders that came after a longer interval than the one before, by customers whose
    intervals had shortened at some time before."""
    line = _with_intervals(orders, customers.select("customer_id"), tie)
    line = with_prev(line, {"_interval_before": "diff_dias_pedidos"})
    line = line.with_columns(
        {
            "flag_aceleracao": flag(F.col("diff_dias_pedidos") < F.col("_interval_before")),
            "flag_desaceleracao": flag(F.col("diff_dias_pedidos") > F.col("_interval_before")),
        }
    )
    line = had_before(line, "flag_aceleracao", "teve_aceleracao_antes").filter(
        (F.col("flag_desaceleracao") == 1)
        & (F.col("teve_aceleracao_antes") == 1)
        & (F.col("online_flag") == 1)
    )
    return report(line.rows().drop("_interval_before"), ["customer_id", "order_date"], ordered)


def order_acceleration_panel(
    orders: DataFrame, customers: DataFrame, people: DataFrame, *,
    names: Iterable[str] = ("customer_name",), tie: Iterable[str] = ("order_id",),
) -> DataFrame:
    """Every order with its interval, acceleration over two steps, a longer interval after any
    such acceleration, and how many of those an accelerating online customer had before.
    Customers without a person keep NULL names."""
    names, tie = list(names), list(tie)
    persons = people.select(F.col("person_id").alias("_person"), *names)
    named = lookup_join(
        customers.select("customer_id", "person_id"), persons, {"person_id": "_person"}
    )
    line = _with_intervals(
        orders.select("customer_id", "order_date", "online_flag", *tie),
        named.select("customer_id", *names),
        tie,
    )
    line = monotone_run(
        line, "diff_dias_pedidos", ["_interval1", "_interval2"], "aceleracao", direction="down"
    )
    line = had_before(line, "aceleracao", "_accelerated")
    line = line.with_columns(
        {
            "flag_desaceleracao": flag(
                (F.col("_accelerated") == 1) & (F.col("diff_dias_pedidos") > F.col("_interval1"))
            )
        }
    ).running({"_slowed": ("sum", F.col("flag_desaceleracao"), "before")})
    return line.rows().select(
        *tie,
        "customer_id",
        *names,
        "order_date",
        F.col("diff_dias_pedidos").alias("intervalo_dias"),
        "aceleracao",
        "flag_desaceleracao",
        F.when(
            (F.col("_accelerated") == 1) & (F.col("online_flag") == 1), F.col("_slowed")
        )
        .otherwise(0)
        .alias("periodo_valido"),
    )
