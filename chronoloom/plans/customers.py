"""Customer overview and generic rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import flag, month_start, ratio
from chronoloom.operators.compose import rank_in_group, top_category
from chronoloom.operators.periods import monthly_rollup
from chronoloom.plans._common import report


def customer_360(
    customers: DataFrame, sales: DataFrame, *, as_of: Column | None = None,
    churn_days: int = 180, ordered: bool = False,
) -> DataFrame:
    """Per customer: totals, favourite category and churn; one row per month with sales, with
    the customer's rank by spend in it. Customers without sales keep one row of NULLs.

    Input: customers (customer_id, country), sales (customer_id, sale_date, category, amount).
    ``as_of`` is the date churn is judged on, by default the last sale date of the data.
    """
    if as_of is None:
        as_of = sales.select(F.to_date(F.max("sale_date"))).scalar()
    # Totals, last date and favourite category all follow from one rollup by category.
    by_category = sales.groupBy("customer_id", "category").agg(
        F.sum("amount").alias("_amount"),
        F.count("amount").alias("_known"),
        F.count(F.lit(1)).alias("_rows"),
        F.max("sale_date").alias("_last"),
    )
    totals = by_category.groupBy("customer_id").agg(
        F.max("_last").alias("ultima_compra"),
        F.sum("_rows").alias("qtd_compras"),
        F.sum("_amount").alias("total_gasto"),
        F.sum("_known").alias("_known"),
        top_category("category", "_amount").alias("categoria_favorita"),
    )
    per_month = rank_in_group(
        monthly_rollup(
            sales, ["customer_id"], "sale_date", [F.sum("amount").alias("_month_total")], "mes"
        ),
        ["mes"],
        "_month_total",
        "rank_mes",
        # A month has at least as many sales as customers; no need for the rollup to count these.
        sizes_from=sales.select(month_start("sale_date").alias("mes")),
    )
    found = (
        customers.select("customer_id", "country")
        .join(totals, "customer_id", "left")
        .join(per_month, "customer_id", "left")
        .select(
            "customer_id",
            "country",
            "ultima_compra",
            "qtd_compras",
            "total_gasto",
            ratio(F.col("total_gasto"), F.col("_known")).alias("ticket_medio"),
            "categoria_favorita",
            F.when(
                F.col("ultima_compra").isNotNull(),
                flag(F.col("ultima_compra") < F.date_sub(as_of, churn_days)),
            ).alias("churn_flag"),
            "mes",
            "rank_mes",
        )
    )
    return report(found, ["customer_id", "mes"], ordered)
