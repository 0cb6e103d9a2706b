"""Fulfilment and delivery: delay periods, SLA streaks and the delivery panel."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import boundary_diff, flag, weekday_number
from chronoloom.operators import islands as isl
from chronoloom.operators.compose import with_group_totals
from chronoloom.operators.lookup import lookup_join
from chronoloom.operators.rolling import trailing_mean
from chronoloom.operators.sequence import monotone_run
from chronoloom.operators.timeline import Timeline
from chronoloom.plans._common import report


def _delay_islands(
    df: DataFrame, entity: str, ts: str, tie: Iterable[str], delay: str, limit: int,
    gap_minutes: int, unknown_is_normal: bool = True,
) -> DataFrame:
    """Late rows, numbered by stretch: late one after another, without a gap between them.

    With ``unknown_is_normal`` a row without a delay ends a stretch; else the next late row
    carries on with the stretch before it.
    """
    line = Timeline.measured(df, [entity], [ts, *tie])
    line = line.with_columns({"_late": flag(F.col(delay) > limit)})
    state = F.col("_late") if unknown_is_normal else (F.col(delay) > limit).cast("int")
    line = line.neighbours(
        lambda w: {"_time": F.lag(ts).over(w), "_was_late": F.lag(state).over(w)}, back=1
    )
    line = line.with_columns(
        {"_gap": isl.gap_flag("minute", "_time", ts, gap_minutes, first_is_gap=False)}
    ).filter(F.col("_late") == 1)
    return isl.assign_islands(
        line, isl.start_flag(isl.ONSET, "_late", "_gap", "_time", "_was_late"), island="_island"
    ).rows()


def warehouse_billing_delay(
    orders: DataFrame, *, entity: str = "warehouse_id", paid: str = "payment_at",
    invoiced: str = "invoice_at", tie: Iterable[str] = ("order_id",), limit_minutes: int = 120,
    gap_minutes: int = 30, min_minutes: int = 60, min_orders: int = 3, ordered: bool = False,
) -> DataFrame:
    """Periods in which a warehouse invoices late, order after order."""
    tie = list(tie)
    timed = orders.select(
        entity, paid, *tie, boundary_diff("minute", paid, invoiced).alias("_delay")
    )
    late = _delay_islands(
        timed, entity, paid, tie, "_delay", limit_minutes, gap_minutes, unknown_is_normal=False
    )
    found = isl.summarize_islands(
        late,
        [entity, F.col("_island").alias("ilha_periodo")],
        [
            F.min(paid).alias("inicio_periodo"),
            F.max(paid).alias("fim_periodo"),
            boundary_diff("minute", F.min(paid), F.max(paid)).alias("duracao_minutos"),
            F.count(F.lit(1)).alias("qnt_pedidos"),
            F.max("_delay").alias("pior_atraso"),
        ],
        (F.col("duracao_minutos") >= min_minutes) & (F.col("qnt_pedidos") >= min_orders),
    )
    return report(found, [entity, "inicio_periodo"], ordered)


def hub_prep_delay(
    orders: DataFrame, *, entity: str = "hub_id", paid: str = "payment_at",
    packed: str = "packed_at", priority: str = "priority_flag",
    tie: Iterable[str] = ("order_id",), limit_minutes: int = 90, gap_minutes: int = 30,
    min_minutes: int = 45, min_orders: int = 2, ordered: bool = False,
) -> DataFrame:
    """Periods in which a hub prepares orders too slowly, with the priority orders among them."""
    tie = list(tie)
    timed = orders.select(
        entity, paid, *tie, priority, boundary_diff("minute", paid, packed).alias("_prep")
    )
    late = _delay_islands(timed, entity, paid, tie, "_prep", limit_minutes, gap_minutes)
    found = isl.summarize_islands(
        late,
        [entity, F.col("_island").alias("inicio_ilha")],
        [
            F.min(paid).alias("inicio_periodo"),
            F.max(paid).alias("fim_periodo"),
            boundary_diff("minute", F.min(paid), F.max(paid)).alias("duracao_periodo_minutos"),
            F.count(F.lit(1)).alias("qtd_pedidos"),
            F.sum(flag(F.col(priority) == 1)).alias("qtd_prioritarios"),
            F.max("_prep").alias("pior_preparacao"),
        ],
        (F.col("duracao_periodo_minutos") >= min_minutes) & (F.col("qtd_pedidos") >= min_orders),
    )
    return report(found, [entity, "inicio_periodo"], ordered)


def driver_sla_streak(
    deliveries: DataFrame, *, entity: str = "driver_id", city: str = "city",
    ready: str = "pickup_ready_at", delivered: str = "delivered_at",
    tie: Iterable[str] = ("delivery_id",), sla_minutes: int = 35, gap_minutes: int = 30,
    min_deliveries: int = 3, min_sla_sum: int = 15, ordered: bool = False,
) -> DataFrame:
    """Streaks of deliveries over the SLA per driver; a streak over two cities counts in each."""
    tie = list(tie)
    timed = deliveries.select(
        entity, city, ready, *tie, boundary_diff("minute", ready, delivered).alias("_sla")
    )
    late = _delay_islands(timed, entity, ready, tie, "_sla", sla_minutes, gap_minutes)
    found = isl.summarize_islands(
        late,
        [entity, city, "_island"],
        [
            F.min(ready).alias("inicio_periodo"),
            F.max(ready).alias("fim_periodo"),
            F.count(F.lit(1)).alias("qnt_entregas"),
            F.max("_sla").alias("pior_sla"),
            F.sum("_sla").alias("aumento_total_sla"),
        ],
        (F.col("qnt_entregas") >= min_deliveries) & (F.col("aumento_total_sla") > min_sla_sum),
    ).drop("_island")
    return report(found, [entity, city], ordered)


def delivery_sla_panel(
    deliveries: DataFrame, *, sla_minutes: int = 60, wait_minutes: int = 30, rows: int = 7,
    ordered: bool = False,
) -> DataFrame:
    """One row per delivery: its times and flags, its place in the driver's day and ranking, and
    totals of its driver and distribution centre.

    Input: delivery_id, delivery_person_id, distribution_center_id, pickup_ready_at,
    out_for_delivery_at, delivered_at.
    """
    ready, out, done = "pickup_ready_at", "out_for_delivery_at", "delivered_at"
    driver, centre = "delivery_person_id", "distribution_center_id"
    timed = deliveries.select("delivery_id", driver, centre, ready, out, done).withColumns(
        {
            "tempo_espera_cd": boundary_diff("minute", ready, out),
            "tempo_rota": boundary_diff("minute", out, done),
            "sla_total_min": boundary_diff("minute", ready, done),
            "hora_pickup": F.hour(ready),
            "dia_semana": weekday_number(ready),
        }
    )
    timed = timed.withColumns(
        {
            "flag_sla_violation": flag(F.col("sla_total_min") > sla_minutes),
            "flag_retenção_cd": flag(F.col("tempo_espera_cd") > wait_minutes),
        }
    )
    line = Timeline.measured(timed, [driver], [ready, "delivery_id"])
    line = line.neighbours(
        lambda w: {"media_movel_atraso_7": trailing_mean("sla_total_min", rows, w)}, back=rows
    ).ranks({"ordem_entrega_motorista": "row_number"})
    line = line.totals(
        {
            "total_atrasos_motorista": F.sum("flag_sla_violation"),
            "pior_atraso_motorista": F.max("sla_total_min"),
        }
    )
    line = line.reordered(["-sla_total_min", "delivery_id"]).ranks(
        {"ranking_pior_entrega_motorista": "dense_rank"}
    )
    panel = with_group_totals(
        line.rows(),
        [centre],
        {
            "total_atrasos_cd": F.sum("flag_sla_violation"),
            "pior_atraso_cd": F.max("sla_total_min"),
        },
        source=timed,
    )
    return report(panel, [driver, ready], ordered)


def driver_slowing(
    drivers: DataFrame, deliveries: DataFrame, *, tie: Iterable[str] = ("delivery_id",)
) -> DataFrame:
    """Deliveries that took longer than the driver's one before, which took longer than the one
    before that. Route time only; drivers without deliveries cannot appear.

    Input: drivers (driver_id, driver_name), deliveries (driver_id, delivery_id, pickup_ready_at,
    out_for_delivery_at, delivered_at).
    """
    timed = deliveries.select(
        "driver_id",
        "delivery_id",
        "pickup_ready_at",
        "out_for_delivery_at",
        "delivered_at",
        boundary_diff("minute", "out_for_delivery_at", "delivered_at").alias("sla_total_min"),
    )
    listed = drivers.select(F.col("driver_id").alias("_driver"), "driver_name")
    known = lookup_join(timed, listed, {"driver_id": "_driver"}, sizes_from=deliveries)
    line = Timeline.measured(
        known.filter(F.col("_driver").isNotNull()).drop("_driver"),
        ["driver_id"],
        ["delivered_at", *tie],
        sizes_from=deliveries,
    )
    slowing = monotone_run(line, "sla_total_min", ["sla_total1", "sla_total2"], "_rising")
    return slowing.rows().filter(F.col("_rising") == 1).drop("_rising")
