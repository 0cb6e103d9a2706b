"""Monthly brand metrics per customer, and their reconciliation.

Input lines: id_cliente, marca, id_venda, order_date, qty, valor_item. The checks take the metrics
as a table; :func:`brand_checks` writes them once and runs all checks on that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import day_diff, flag, month_end, ratio
from chronoloom.operators.checks import agree, compare_totals, materialise, violations
from chronoloom.operators.compose import share_and_rank
from chronoloom.operators.rolling import trailing_mean, trailing_sum
from chronoloom.operators.sizes import dealt
from chronoloom.operators.timeline import Timeline

_MONTH = ["id_cliente", "ano", "mes"]
_CELL = ["id_cliente", "marca", "ano", "mes"]


def _dated(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"ano": F.year("order_date"), "mes": F.month("order_date")}).filter(
        F.col("id_cliente").isNotNull() & F.col("order_date").isNotNull()
    )


def brand_metrics(
    lines: DataFrame, *, rows: int = 3, repurchases: int = 3, spike: float = 1.5,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Spend, frequency, ticket and recency per customer, brand and month; trailing mean, share
    of the customer's month, repurchase and spike flags, and rank.

    "Months" of the trailing figures are rows: months without a purchase do not count. After the
    rollup a customer and brand has one row per month, a customer's month one row per brand.

    Counting sales takes a row per sale in memory. ``sizes_from`` is a cheaper table with as many
    rows as there are lines: by their number the lines are dealt into tasks of bounded size.
    """
    dated = _dated(lines)
    if sizes_from is not None:
        dated = dealt(dated, sizes_from.count(), *_CELL, "id_venda")
    monthly = (
        dated
        .groupBy(*_CELL)
        .agg(
            F.sum("valor_item").alias("total_mes_marca"),
            F.count_distinct("id_venda").alias("freq_marca"),
            F.sum("qty").alias("_qty"),
            F.count(F.lit(1)).alias("_lines"),
            F.max("order_date").alias("_last"),
        )
        .withColumns(
            {
                "ticket_med_marca": F.nullif(
                    ratio(F.col("total_mes_marca"), F.col("_qty")), F.lit(0.0)
                ),
                "recencia": day_diff(F.col("_last"), month_end("_last")),
            }
        )
    )
    line = Timeline.bounded(monthly, ["id_cliente", "marca"], ["ano", "mes"]).neighbours(
        lambda w: {
            "media_3m": trailing_mean("ticket_med_marca", rows, w),
            "contagem_3meses": trailing_sum("_lines", rows, w),
        },
        back=rows,
    )
    ranked = share_and_rank(
        line.rows(), _MONTH, "total_mes_marca", "rank_cliente_marca", "_month_total",
        "part_pct_marca",
    )
    return ranked.withColumns(
        {
            "taxa_recompra_flag": flag(F.col("contagem_3meses") == repurchases),
            "flag_explosao": flag(F.col("total_mes_marca") > F.col("media_3m") * spike),
        }
    ).select(
        *_CELL,
        "total_mes_marca",
        "freq_marca",
        "part_pct_marca",
        "recencia",
        "ticket_med_marca",
        "media_3m",
        "contagem_3meses",
        "taxa_recompra_flag",
        "flag_explosao",
        "rank_cliente_marca",
    )


def brand_checks_total(metrics: DataFrame, lines: DataFrame) -> DataFrame:
    """Customer's month as the sum of its brands against the sum of its lines."""
    parts = metrics.groupBy(*_MONTH).agg(F.sum("total_mes_marca").alias("soma_marcas"))
    whole = _dated(lines).groupBy(*_MONTH).agg(
        F.sum("valor_item").alias("total_mes_cliente_calc")
    )
    return compare_totals(
        parts, whole, _MONTH, "soma_marcas", "total_mes_cliente_calc", "diff"
    )


def brand_checks_ticket(metrics: DataFrame) -> DataFrame:
    """Ticket per unit against spend per sale; they differ whenever units and sales do."""
    return metrics.select(
        *_CELL,
        "ticket_med_marca",
        ratio(F.col("total_mes_marca"), F.col("freq_marca")).alias("ticket_calc"),
    ).withColumn(
        "valida_ticket",
        F.when(agree(F.col("ticket_med_marca"), F.col("ticket_calc")), "OK").otherwise("Erro"),
    )


def brand_checks_flags(
    metrics: DataFrame, *, repurchases: int = 3, spike: float = 1.5
) -> DataFrame:
    """Rows whose repurchase or spike flag contradicts the figures it comes from."""
    return violations(
        metrics,
        [
            (F.col("contagem_3meses") < repurchases) & (F.col("taxa_recompra_flag") == 1),
            (F.col("total_mes_marca") <= F.col("media_3m") * spike)
            & (F.col("flag_explosao") == 1),
        ],
    )


def brand_checks(lines: DataFrame, folder: str) -> dict[str, DataFrame]:
    """All three checks on metrics computed once and kept in ``folder``. The total is compared with
    one taken from the lines anew, as a check must not rest on what it checks."""
    metrics = materialise(brand_metrics(lines), folder)
    return {
        "total": brand_checks_total(metrics, lines),
        "ticket": brand_checks_ticket(metrics),
        "flags": brand_checks_flags(metrics),
    }
