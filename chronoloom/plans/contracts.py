"""Facts priced or classified by the version valid at their time: subscriptions, contracts,
price lists, warranties, licences and campaigns.

Of versions of a key that start on the same day only the one that ends last is meant to count.
A match needs no step for that: such a version covers whatever the others cover, and the order of
preference (end and start, then ``version_tie``, largest first) picks it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import day_diff, flag, inclusive_days, month_end, month_start
from chronoloom.operators.compose import band_label, merge_metrics, resolve_price
from chronoloom.operators.dedup import keep_latest
from chronoloom.operators.lookup import lookup_join, sorted_if_large
from chronoloom.operators.periods import monthly_rollup
from chronoloom.operators.sequence import with_prev
from chronoloom.operators.timeline import Timeline
from chronoloom.operators.validity import Versions, interval_match_all, interval_match_best
from chronoloom.plans._common import report


def _clean(versions: DataFrame, key: str, tie: Iterable[str]) -> DataFrame:
    """Of versions with the same key and start, the one that ends last."""
    return keep_latest(versions, [key, "start_date"], ["-end_date", *tie])


def subscription_churn_risk(
    logs: DataFrame, cancellations: DataFrame, *, log_order: Iterable[str] = (),
    min_days: int = 2, max_idle_days: int = 20, ordered: bool = False,
) -> DataFrame:
    """Monthly use per customer, days since the last use before the month, cancellations, and
    the risk of churn: fewer than ``min_days`` active days or idle beyond ``max_idle_days``.

    Input: logs (log_id, customer_id, log_date, duration_minutes), cancellations (customer_id,
    cancel_date). Two cancellations in a month give two rows. The subscription of a log is not
    needed: the match keeps each log exactly once, so it cannot change these figures; it is
    ``resolved_logs``.
    """
    logs = keep_latest(logs, ["log_id"], ["-log_date", *log_order])
    used = monthly_rollup(
        logs, ["customer_id"], "log_date",
        [
            F.sum("duration_minutes").alias("total_minutes"),
            F.count_distinct(F.to_date("log_date")).alias("active_days"),
            F.max("log_date").alias("_last"),
        ],
        month="mes",
    )
    # One row per customer and month: the latest log of earlier months is that of the row before.
    used = (
        with_prev(Timeline.bounded(used, ["customer_id"], ["mes"]), {"_before": "_last"})
        .rows()
        .withColumn("days_since_last_use", day_diff("_before", "mes"))
    )
    cancelled = cancellations.select(
        F.col("customer_id").alias("_customer"), month_start("cancel_date").alias("_mes")
    )
    merged = used.join(
        cancelled,
        (F.col("customer_id") == F.col("_customer")) & (F.col("mes") == F.col("_mes")),
        "full",
    )
    churned = flag(F.col("_mes").isNotNull())
    risky = (F.col("active_days") < min_days) | (F.col("days_since_last_use") > max_idle_days)
    found = merged.select(
        F.coalesce("customer_id", "_customer").alias("customer_id"),
        F.coalesce("mes", "_mes").alias("mes"),
        "total_minutes",
        "active_days",
        "days_since_last_use",
        churned.alias("churned_month"),
        flag((churned == 0) & risky).alias("churn_risk"),
    )
    return report(found, ["customer_id", "mes"], ordered)


def resolved_logs(
    subscriptions: DataFrame, logs: DataFrame, *, log_order: Iterable[str] = (),
    version_tie: Iterable[str] = ("subscription_id",), times_from: DataFrame | None = None,
) -> DataFrame:
    """Each log once, with the subscription valid at its time (the one that ends last).
    ``times_from`` is a cheaper table with the log_date of every log."""
    return interval_match_best(
        keep_latest(logs, ["log_id"], ["-log_date", *log_order]),
        subscriptions,
        key="customer_id",
        at="log_date",
        prefer=["end_date", "start_date", *version_tie],
        take={"subscription_id": "subscription_id", "monthly_fee": "monthly_fee"},
        sizes_from=logs,
        times_from=times_from,
    )


def subscription_activity(
    subscriptions: DataFrame, usage: DataFrame, invoices: DataFrame, *,
    version_tie: Iterable[str] = ("subscription_id",), ordered: bool = False,
) -> DataFrame:
    """Active days, events and paid revenue per customer and month; churn without active days.

    A subscription counts in the month it starts, up to that month's end. Input: subscriptions
    (customer_id, start_date, end_date), usage (customer_id, event_time), invoices (customer_id,
    invoice_date, amount, status).
    """
    keys = ["customer_id", "mes"]
    latest_first = [f"-{c}" for c in version_tie]
    clean = _clean(subscriptions, "customer_id", latest_first).withColumn(
        "mes", month_start("start_date")
    )
    days = inclusive_days("start_date", F.least("end_date", month_end("start_date")))
    merged = merge_metrics(
        [
            (clean, {"dias_ativos": days.cast("bigint")}),
            (usage.withColumn("mes", month_start("event_time")), {"qtd_eventos": F.lit(1)}),
            (
                invoices.filter(F.col("status") == "paid").withColumn(
                    "mes", month_start("invoice_date")
                ),
                {"receita_mes": F.col("amount")},
            ),
        ],
        keys,
    ).withColumn("churn_flag", flag(F.col("dias_ativos").isNull()))
    return report(merged, keys, ordered)


def contract_billing(
    contracts: DataFrame, bills: DataFrame, *, version_tie: Iterable[str] = (),
    bill_order: Iterable[str] = (), sizes_from: DataFrame | None = None, ordered: bool = False,
) -> DataFrame:
    """Bills priced by the contract version valid on their date, per customer and month.

    Input: contracts (contract_id, customer_id, start_date, end_date, base_price), bills
    (bill_id, contract_id, bill_date, qty). ``sizes_from`` is a cheaper table with the contract_id
    of every bill, to count busy contracts in.
    """
    priced = interval_match_best(
        bills,
        contracts,
        key="contract_id",
        at="bill_date",
        prefer=["end_date", "start_date", *version_tie],
        take={"customer_id": "customer_id", "base_price": "base_price"},
        fact_id=["bill_id"],
        fact_order=bill_order,
        sizes_from=sizes_from,
    )
    monthly = monthly_rollup(
        priced, ["customer_id"], "bill_date",
        [
            F.sum(F.col("qty") * F.col("base_price")).alias("receita_mensal"),
            F.count(F.lit(1)).alias("qtd_faturas"),
        ],
        month="mes",
    )
    return report(monthly, ["customer_id", "mes"], ordered)


def price_anomaly(
    orders: DataFrame, prices: DataFrame, *, line_order: Iterable[str] = (),
    version_tie: Iterable[str] = (), low: float = 0.5, high: float = 1.8,
    sizes_from: DataFrame | None = None, ordered: bool = False,
) -> DataFrame:
    """Order lines with their final price (the historical one where none was given) and whether
    that is far from the product's mean list price.

    Input: orders (order_id, product_id, customer_id, order_date, quantity, unit_price), prices
    (product_id, start_date, end_date, price). ``sizes_from`` is a cheaper table with the
    product_id of every line, to count busy products in.
    """
    sizes_from = orders if sizes_from is None else sizes_from
    lines = keep_latest(orders, ["order_id", "product_id"], ["-order_date", *line_order])
    priced = interval_match_best(
        lines,
        prices,
        key="product_id",
        at="order_date",
        prefer=["end_date", "start_date", *version_tie],
        take={"price": "_historical"},
        sizes_from=sizes_from,
    )
    clean = _clean(prices, "product_id", [f"-{c}" for c in version_tie])
    means = clean.groupBy(F.col("product_id").alias("_product")).agg(
        F.try_divide(F.sum("price").cast("double"), F.count("price").cast("double")).alias("_mean")
    )
    found = (
        lookup_join(
            priced, means, {"product_id": "_product"}, right_rows=prices.count(),
            sizes_from=sizes_from,
        )
        .withColumn("final_price", resolve_price("unit_price", "_historical"))
        .select(
            "order_id",
            "product_id",
            "customer_id",
            "order_date",
            "quantity",
            "final_price",
            band_label("final_price", "_mean", low, high).alias("price_flag"),
        )
    )
    return report(found, ["order_date", "product_id"], ordered)


def _with_sale(claims: DataFrame, sales: DataFrame, *columns: str) -> DataFrame:
    sold = sorted_if_large(sales.select("sale_id", *columns), sales.count())
    return claims.join(sold, "sale_id", "left")


def resolved_claims(
    sales: DataFrame, warranties: DataFrame, claims: DataFrame, *,
    claim_order: Iterable[str] = (), version_tie: Iterable[str] = (),
) -> DataFrame:
    """Each claim once, with its sale and the coverage valid on the claim date."""
    clean = keep_latest(claims, ["claim_id"], ["-claim_date", *claim_order])
    of_sale = _with_sale(clean, sales, "customer_id", "product_id")
    return interval_match_best(
        of_sale,
        warranties,
        key="product_id",
        at="claim_date",
        prefer=["end_date", "start_date", *version_tie],
        take={"coverage_level": "coverage_level"},
    )


def warranty_claims(
    sales: DataFrame, claims: DataFrame, *, claim_order: Iterable[str] = (),
    ordered: bool = False,
) -> DataFrame:
    """Sales and claims side by side per customer and month, months with only one of them too.

    Input: sales (sale_id, customer_id, product_id, sale_date, sale_price), claims (claim_id,
    sale_id, claim_date, claim_cost). Coverage does not enter the monthly figures: the match
    keeps each claim exactly once; see ``resolved_claims``.
    """
    clean = keep_latest(claims, ["claim_id"], ["-claim_date", *claim_order])
    of_sale = _with_sale(clean, sales, "customer_id").withColumn("mes", month_start("claim_date"))
    keys = ["customer_id", "mes"]
    merged = merge_metrics(
        [
            (
                sales.withColumn("mes", month_start("sale_date")),
                {"produtos_no_mes": F.lit(1), "receita_mes": F.col("sale_price")},
            ),
            (of_sale, {"qtd_claims": F.lit(1), "custo_claims": F.col("claim_cost")}),
        ],
        keys,
    )
    return report(merged, keys, ordered)


def license_usage(
    licenses: DataFrame, usage: DataFrame, countries: DataFrame, *,
    usage_order: Iterable[str] = (), version_tie: Iterable[str] = (),
    times_from: DataFrame | None = None, ordered: bool = False,
) -> DataFrame:
    """Use, licence revenue and events per customer, country and month.

    Input: licenses (license_id, customer_id, start_date, end_date, price), usage (event_id,
    customer_id, event_date, usage_amount), countries (customer_id, country). ``times_from`` is a
    cheaper table with the event_date of every event.
    """
    matched = interval_match_best(
        keep_latest(usage, ["event_id"], ["-event_date", *usage_order]),
        licenses,
        key="customer_id",
        at="event_date",
        prefer=["end_date", "start_date", *version_tie],
        take={"price": "price"},
        sizes_from=usage,
        times_from=times_from,
    )
    # Summed per customer and month before the country is looked up: fewer rows to join.
    monthly = monthly_rollup(
        matched, ["customer_id"], "event_date",
        [
            F.sum("usage_amount").alias("total_usage"),
            F.sum("price").alias("receita_mes"),
            F.count(F.lit(1)).alias("eventos"),
        ],
        month="mes",
    )
    found = (
        monthly.join(countries.select("customer_id", "country"), "customer_id", "left")
        .groupBy("customer_id", "country", "mes")
        .agg(*(F.sum(c).alias(c) for c in ("total_usage", "receita_mes", "eventos")))
    )
    return report(found, ["customer_id", "mes"], ordered)


def effective_price(
    sales: DataFrame, prices: DataFrame, campaigns: DataFrame, *,
    sale_order: Iterable[str] = (), version_tie: Iterable[str] = (),
    sizes_from: DataFrame | None = None, ordered: bool = False,
) -> DataFrame:
    """Each sale with the best campaign of its day, the price version that started last, and the
    price after discount.

    Input: sales (sale_id, product_id, sale_date, qty), prices (product_id, start_date, end_date,
    price), campaigns (product_id, start_date, end_date, discount_pct). ``sizes_from`` is a cheaper
    table with the product_id of every sale, to count busy products in.
    """
    sizes_from = sales if sizes_from is None else sizes_from
    priced = interval_match_all(
        sales,
        [
            Versions(campaigns, ["discount_pct"], {"discount_pct": "discount_pct"}),
            Versions(prices, ["start_date", "end_date", *version_tie], {"price": "price"}),
        ],
        key="product_id",
        at="sale_date",
        fact_id=["sale_id"],
        fact_order=sale_order,
        sizes_from=sizes_from,
    )
    gross = F.col("qty") * F.col("price")
    found = priced.select(
        "sale_id",
        "product_id",
        "sale_date",
        "qty",
        "price",
        "discount_pct",
        F.when(F.col("discount_pct").isNull(), gross)
        .otherwise(gross * (1 - F.col("discount_pct")))
        .alias("preco_efetivo"),
    )
    return report(found, ["sale_id"], ordered)
