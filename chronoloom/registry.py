"""The registered queries: every job over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import as_doubles
from chronoloom.operators.compose import metrics_rollup
from chronoloom.operators.periods import monthly_rollup
from chronoloom.operators.storage import scope, shared_stage
from chronoloom.plans import (
    brands,
    churn,
    contracts,
    customers,
    delivery,
    instability,
    orders,
    usage,
)
from chronoloom.sources.inputs import Inputs

Query = Callable[[SparkSession, str], DataFrame]

# The data has readings hours apart, so gaps are given in days; durations are not filtered where
# the default would leave nothing.
DAY_MINUTES, DAY_SECONDS = 1440, 86400
_SERIES = {"entity": "entity_id", "ts": "event_time", "tie": ["event_id"]}
_LATENCY = {**_SERIES, "status": "status_code", "latency": "reading"}
_LINE_ORDER = ["l_linenumber", "l_suppkey", "l_extendedprice"]
_LOG_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice"]


def _finish(df: DataFrame, **rounded: int) -> DataFrame:
    """Plain doubles for output; means rounded, as their last bits depend on the engine."""
    df = as_doubles(df)
    return df.withColumns({c: F.round(c, digits) for c, digits in rounded.items()})


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def _contracts(i: Inputs) -> DataFrame:
    return _renamed(
        i.versions(), contract_id="product_id", customer_id="customer_id",
        start_date="start_date", end_date="end_date", base_price="price",
    )


def _bill_id() -> Column:
    return (F.col("order_id") * 8 + F.col("l_linenumber")).alias("bill_id")


def _bills(i: Inputs) -> DataFrame:
    return i.order_lines().select(
        _bill_id(),
        F.col("product_id").alias("contract_id"),
        F.col("order_date").alias("bill_date"),
        F.col("quantity").alias("qty"),
        "product_id",
        "l_suppkey",
        "l_extendedprice",
    )


def _priced_sales(i: Inputs) -> DataFrame:
    return i.order_lines().select(
        _bill_id().alias("sale_id"),
        "product_id",
        F.col("order_date").alias("sale_date"),
        F.col("quantity").alias("qty"),
        "l_suppkey",
        "l_extendedprice",
    )


def _licenses(i: Inputs) -> DataFrame:
    return _renamed(
        i.subscriptions(), license_id="subscription_id", customer_id="customer_id",
        start_date="start_date", end_date="end_date", price="monthly_fee",
    )


def _license_events(i: Inputs) -> DataFrame:
    return _renamed(
        i.usage_logs(), event_id="log_id", customer_id="customer_id", event_date="log_date",
        usage_amount="duration_minutes", **{c: c for c in _LOG_ORDER},
    )


def _panel_deliveries(i: Inputs) -> DataFrame:
    return i.deliveries().withColumnsRenamed(
        {"driver_id": "delivery_person_id", "centre_id": "distribution_center_id"}
    )


def _drivers(i: Inputs) -> DataFrame:
    return i.table("customer").select(
        F.col("c_custkey").alias("driver_id"), F.col("c_name").alias("driver_name")
    )


def _line_keys(i: Inputs, name: str, at: str) -> DataFrame:
    """The part and the time of every line: lookups by part count their busy keys in them and take
    the first and last time, without a join."""
    return _renamed(i.table("lineitem"), **{name: "l_partkey", at: "l_shipdate"})


def _line_times(i: Inputs, at: str) -> DataFrame:
    return _renamed(i.table("lineitem"), **{at: "l_shipdate"})


def _brand_metrics(i: Inputs, sales: bool = True) -> DataFrame:
    """Computed once for all queries of a scope that ask for it; ``sales`` tells whether the number
    of sales is read, for which lines are dealt by their number."""
    return shared_stage(
        i.spark,
        ("brand_metrics", i.folder),
        lambda: brands.brand_metrics(
            i.brand_lines(), sizes_from=i.table("lineitem") if sales else None
        ),
    )


_BRAND_ROUND = {"part_pct_marca": 6, "ticket_med_marca": 6, "media_3m": 6}

_JOBS: dict[str, Callable[[Inputs], DataFrame]] = {
    # churn
    "churn_recency": lambda i: churn.churn_recency(i.customer_events()),
    "churn_gap_episodes": lambda i: churn.churn_gap_episodes(
        i.customer_events(), ts="event_time", tie=["event_id"]
    ),
    "churn_gap_reactivation": lambda i: churn.churn_gap_reactivation(
        i.customer_events(), tie=["event_id"]
    ),
    "calendar_churn": lambda i: churn.calendar_churn(i.customer_events(), ts="event_time"),
    "customer_calendar": lambda i: churn.customer_calendar(i.customer_events()),
    # monthly usage
    "feature_drop": lambda i: usage.feature_drop(i.feature_events()),
    "feature_drop_cross": lambda i: usage.feature_drop_cross(i.feature_events()),
    "usage_drop_run": lambda i: usage.usage_drop_run(
        monthly_rollup(
            i.feature_usage(), ["customer_id"], "event_date",
            [F.count(F.lit(1)).alias("eventos_mes")],
        )
    ),
    "usage_drop_run_raw": lambda i: usage.usage_drop_run_raw(i.feature_usage()),
    "usage_drop_severe": lambda i: usage.usage_drop_severe(i.feature_usage()),
    "product_usage_risk": lambda i: _finish(
        usage.product_usage_risk(i.customers(), i.product_usage(), i.products()),
        pct_variacao=6,
    ),
    # validity intervals
    "subscription_churn_risk": lambda i: _finish(
        contracts.subscription_churn_risk(
            i.usage_logs(), i.cancellations(), log_order=_LOG_ORDER
        )
    ),
    "resolved_logs": lambda i: _finish(
        contracts.resolved_logs(
            i.subscriptions(), i.usage_logs(), log_order=_LOG_ORDER,
            times_from=_line_times(i, "log_date"),
        ).drop(*_LOG_ORDER)
    ),
    "subscription_activity": lambda i: _finish(
        contracts.subscription_activity(
            i.subscriptions(), _renamed(i.usage_logs(), customer_id="customer_id",
                                        event_time="log_date"), i.invoices()
        )
    ),
    "contract_billing": lambda i: _finish(
        contracts.contract_billing(
            _contracts(i), _bills(i), version_tie=["customer_id", "base_price"],
            bill_order=["-bill_date", "product_id", "l_suppkey", "l_extendedprice"],
            sizes_from=_line_keys(i, "contract_id", "bill_date"),
        )
    ),
    "price_anomaly": lambda i: _finish(
        contracts.price_anomaly(
            i.order_lines(), i.versions(), line_order=_LINE_ORDER, version_tie=["price"],
            sizes_from=_line_keys(i, "product_id", "order_date"),
        )
    ),
    "resolved_claims": lambda i: _finish(
        contracts.resolved_claims(i.sales(), i.versions(), i.claims(), version_tie=["price"])
    ),
    "warranty_claims": lambda i: _finish(
        contracts.warranty_claims(
            i.sales().withColumnRenamed("amount", "sale_price"), i.claims()
        )
    ),
    "license_usage": lambda i: _finish(
        contracts.license_usage(
            _licenses(i), _license_events(i), i.customers(), usage_order=_LOG_ORDER,
            version_tie=["license_id"], times_from=_line_times(i, "event_date"),
        )
    ),
    "effective_price": lambda i: _finish(
        contracts.effective_price(
            _priced_sales(i), i.versions(), i.campaigns(),
            sale_order=["-sale_date", "product_id", "l_suppkey", "l_extendedprice"],
            version_tie=["price"],
            sizes_from=_line_keys(i, "product_id", "sale_date"),
        )
    ),
    # customers
    "customer_360": lambda i: _finish(
        customers.customer_360(i.customers(), i.sales()), ticket_medio=6
    ),
    # islands
    "temperature_jumps": lambda i: _finish(
        instability.temperature_jumps(
            i.readings(), ts="event_time", value="reading", tie=["event_id"]
        )
    ),
    "terminal_instability": lambda i: _finish(
        instability.terminal_instability(i.readings(), **_LATENCY, gap_minutes=DAY_MINUTES)
    ),
    "terminal_instability_spread": lambda i: _finish(
        instability.terminal_instability(
            i.readings(), **_LATENCY, gap_minutes=DAY_MINUTES, spread=True
        )
    ),
    "node_instability": lambda i: _finish(
        instability.node_instability(
            i.readings(), **_LATENCY, gap_minutes=DAY_MINUTES, min_minutes=0
        )
    ),
    "device_irregular": lambda i: instability.device_irregular(
        i.readings(), **_SERIES, temp="reading", gap_seconds=DAY_SECONDS
    ),
    "sensor_drift": lambda i: instability.sensor_drift(
        i.readings(), **_SERIES, gap_seconds=DAY_SECONDS
    ),
    "energy_anomaly": lambda i: instability.energy_anomaly(
        i.readings(), **_SERIES, value="reading", gap_minutes=DAY_MINUTES
    ),
    "energy_anomaly_spread": lambda i: instability.energy_anomaly(
        i.readings(), **_SERIES, value="reading", gap_minutes=DAY_MINUTES, spread=True
    ),
    "job_degraded": lambda i: _finish(
        instability.job_degraded(i.readings(), **_SERIES, gap_minutes=DAY_MINUTES)
    ),
    "job_span": lambda i: _finish(
        instability.job_span(i.readings(), entity="entity_id")
    ),
    "job_degraded_loose": lambda i: _finish(
        instability.job_degraded_loose(i.readings(), **_SERIES, gap_minutes=DAY_MINUTES)
    ),
    "seller_decline": lambda i: _finish(
        instability.seller_decline(i.seller_daily()),
        media_orders_baseline=6, media_revenue_baseline=4,
    ),
    # deliveries
    "warehouse_billing_delay": lambda i: delivery.warehouse_billing_delay(
        i.fulfilment(), entity="hub_id", gap_minutes=120
    ),
    "hub_prep_delay": lambda i: delivery.hub_prep_delay(i.fulfilment(), gap_minutes=120),
    "driver_sla_streak": lambda i: delivery.driver_sla_streak(
        i.deliveries(), gap_minutes=DAY_MINUTES
    ),
    "delivery_sla_panel": lambda i: _finish(
        delivery.delivery_sla_panel(_panel_deliveries(i)), media_movel_atraso_7=6
    ),
    "driver_slowing": lambda i: delivery.driver_slowing(_drivers(i), i.deliveries()),
    # orders
    "order_deceleration": lambda i: _finish(
        orders.order_deceleration(i.order_headers(), i.customers())
    ),
    "order_acceleration_panel": lambda i: orders.order_acceleration_panel(
        i.order_headers(), i.customer_people(), i.people()
    ),
    # brands
    "brand_metrics": lambda i: _finish(_brand_metrics(i), **_BRAND_ROUND),
    "brand_checks_total": lambda i: _finish(
        brands.brand_checks_total(_brand_metrics(i, sales=False), i.brand_lines())
    ),
    "brand_checks_ticket": lambda i: _finish(
        brands.brand_checks_ticket(_brand_metrics(i)), ticket_med_marca=6, ticket_calc=6
    ),
    "brand_checks_flags": lambda i: _finish(
        brands.brand_checks_flags(_brand_metrics(i)), **_BRAND_ROUND
    ),
    "metrics_rollup": lambda i: _finish(
        metrics_rollup(
            i.table("orders").withColumn(
                "o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")
            ),
            ["o_orderpriority", "o_orderstatus"],
            "o_totalprice",
        ),
        media_medida=6,
    ),
}


def queries() -> dict[str, Query]:
    def bind(job: Callable[[Inputs], DataFrame]) -> Query:
        return lambda spark, folder: job(Inputs(spark, folder))

    return {name: bind(job) for name, job in _JOBS.items()}


def write_all(
    spark: SparkSession,
    folder: str,
    names: Iterable[str],
    write: Callable[[str, DataFrame], None],
) -> None:
    """Run registered queries in one scope: each result goes to ``write`` with its name, stages
    that several of them read are computed once, and what was stored on the way is deleted at the
    end, after a failure too."""
    jobs = queries()
    with scope(spark):
        for name in names:
            write(name, jobs[name](spark, folder))
