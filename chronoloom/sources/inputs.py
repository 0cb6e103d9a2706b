"""The jobs' logical inputs as views over the parquet tables of a data folder.

Each view renames and derives columns over the whole table; rows are chosen by natural attributes
only (a cancellation is an order with status F). Money is cast to DECIMAL, so that sums are exact
and do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.lookup import BROADCAST_ROWS, sorted_if_large
from chronoloom.operators.sizes import dealt

# Stated, not inferred: reading a folder then needs no job to look at its files.
SCHEMAS = {
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
}


def _money(c: Column | str, kind: str = "decimal(18,2)") -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(kind)


def _minutes(c: Column) -> Column:
    return F.make_dt_interval(mins=c.cast("int"))


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def _lines_with(
        self, lines: DataFrame, key: str, name: str, its_key: str, *columns: str
    ) -> DataFrame:
        """Lines joined with the rows of another table; rows are counted in the files' footers."""
        table = self.table(name).select(its_key, *columns)
        few, many = table.count(), self.table("lineitem").count()
        if few > BROADCAST_ROWS:
            lines, table = dealt(lines, many, key), dealt(table, many, its_key)
        return lines.join(sorted_if_large(table, few), F.col(key) == F.col(its_key))

    def _order_lines_joined(self) -> DataFrame:
        lines = self.table("lineitem")
        return self._lines_with(
            lines, "l_orderkey", "orders", "o_orderkey", "o_custkey", "o_orderdate"
        )

    def _order_lines_of_parts(self, *columns: str) -> DataFrame:
        lines = self._order_lines_joined()
        return self._lines_with(lines, "l_partkey", "part", "p_partkey", *columns)

    # -- events of customers ---------------------------------------------------------------

    def customer_events(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("event_time"),
            F.col("o_orderkey").alias("event_id"),
        )

    def feature_events(self) -> DataFrame:
        priority = F.col("o_orderpriority")
        return self.table("orders").select(
            (F.col("o_custkey") % 20).alias("customer_id"),
            F.col("o_orderdate").alias("event_time"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), "export")
            .when(priority == "3-MEDIUM", "upload")
            .otherwise("other")
            .alias("feature_name"),
        )

    def feature_usage(self) -> DataFrame:
        return self.table("orders").select(
            (F.col("o_custkey") % 50).alias("customer_id"),
            F.col("o_orderdate").alias("event_date"),
        )

    def customers(self) -> DataFrame:
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_name"),
                F.col("n_name").alias("country"),
            )
        )

    def product_usage(self) -> DataFrame:
        return self._order_lines_joined().select(
            (F.col("o_custkey") % 50).alias("customer_id"),
            # One id in five, -1, belongs to no product.
            (F.col("l_partkey") % 5 - 1).alias("product_id"),
            F.col("l_shipdate").alias("usage_date"),
            _money("l_quantity").alias("usage_count"),
        )

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name")
        )

    def customer_people(self) -> DataFrame:
        """Customers of one market segment are shops, which no person stands for."""
        person = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey"))
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"), person.alias("person_id")
        )

    def people(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("person_id"), F.col("c_name").alias("customer_name")
        )

    # -- time series -----------------------------------------------------------------------

    def readings(self) -> DataFrame:
        kind = F.col("event_type")
        value = _money("value")
        return self.table("events").select(
            F.col("user_id").alias("entity_id"),
            F.col("ts").alias("event_time"),
            "event_id",
            value.alias("reading"),
            (F.lit(100) + (F.col("event_id") * 37 % 100) * 0.5).alias("pressure"),
            F.when(kind == "error", 1).otherwise(0).alias("status_code"),
            (value * 20).alias("processing_time_ms"),
            F.when(kind == "error", 1)
            .when(kind == "signup", F.lit(None).cast("int"))
            .otherwise(0)
            .alias("error_count"),
        )

    def seller_daily(self) -> DataFrame:
        return (
            self.table("orders")
            .groupBy(
                (F.col("o_custkey") % 3).alias("seller_id"),
                F.to_date("o_orderdate").alias("sale_date"),
            )
            .agg(
                F.count(F.lit(1)).alias("total_orders"),
                F.sum(_money("o_totalprice")).alias("total_revenue"),
            )
        )

    def deliveries(self) -> DataFrame:
        out = F.floor("value")
        return self.table("events").select(
            F.col("event_id").alias("delivery_id"),
            F.col("user_id").alias("driver_id"),
            (F.col("user_id") % 10).alias("centre_id"),
            F.concat(F.lit("CITY_"), (F.col("user_id") % 25).cast("string")).alias("city"),
            F.col("ts").alias("pickup_ready_at"),
            (F.col("ts") + _minutes(out)).alias("out_for_delivery_at"),
            (F.col("ts") + _minutes(out + 5 + F.col("event_id") % 40)).alias("delivered_at"),
        )

    def fulfilment(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("order_id"),
            (F.col("user_id") % 20).alias("hub_id"),
            F.col("ts").alias("payment_at"),
            (F.col("ts") + _minutes(F.floor(F.col("value") * 3))).alias("invoice_at"),
            (F.col("ts") + _minutes(F.floor(F.col("value") * 2))).alias("packed_at"),
            F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("priority_flag"),
        )

    # -- subscriptions and billing ---------------------------------------------------------

    def subscriptions(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("subscription_id"),
            F.col("o_custkey").alias("customer_id"),
            F.to_date("o_orderdate").alias("start_date"),
            F.date_add(
                F.to_date("o_orderdate"), (F.lit(30) + F.col("o_orderkey") % 60).cast("int")
            ).alias("end_date"),
            F.col("o_orderpriority").alias("plan_type"),
            _money("o_totalprice").alias("monthly_fee"),
        )

    def usage_logs(self) -> DataFrame:
        return self._order_lines_joined().select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("log_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_shipdate").alias("log_date"),
            F.col("l_returnflag").alias("feature"),
            _money("l_quantity").alias("duration_minutes"),
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
        )

    def cancellations(self) -> DataFrame:
        return (
            self.table("orders")
            .filter(F.col("o_orderstatus") == "F")
            .select(
                F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("cancel_date")
            )
        )

    def invoices(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("invoice_date"),
            _money("o_totalprice").alias("amount"),
            F.when(F.col("o_orderstatus") == "O", "open").otherwise("paid").alias("status"),
        )

    # -- prices and sales ------------------------------------------------------------------

    def versions(self) -> DataFrame:
        years = F.explode(F.array(*(F.lit(y) for y in range(1996, 2001))))
        kinds = F.explode(F.array(F.lit(0), F.lit(1)))
        listed = _money("p_retailprice", "decimal(8,2)")
        dearer = (1 + F.lit(0.02) * (F.col("_year") - 1995)).cast("decimal(4,2)")
        plus = (1 + F.lit(0.1) * F.col("_kind")).cast("decimal(3,1)")
        first = F.make_date(F.col("_year"), F.lit(1), F.lit(1))
        return (
            self.table("part")
            .withColumn("_year", years)
            .withColumn("_kind", kinds)
            .filter((F.col("_kind") == 0) | (F.col("p_partkey") % 10 == 0))
            .select(
                F.col("p_partkey").alias("product_id"),
                first.alias("start_date"),
                F.date_add(first, (F.lit(380) + 30 * F.col("_kind")).cast("int")).alias("end_date"),
                (listed * dearer * plus).cast("decimal(12,5)").alias("price"),
                F.when(F.col("_kind") == 1, "plus").otherwise("base").alias("coverage_level"),
                (F.col("p_partkey") % 100).alias("customer_id"),
            )
        )

    def campaigns(self) -> DataFrame:
        years = F.explode(F.array(F.lit(1996), F.lit(1998), F.lit(2000)))
        kinds = F.explode(F.array(F.lit(0), F.lit(1)))
        shift = (30 * F.col("_kind")).cast("int")
        return (
            self.table("part")
            .withColumn("_year", years)
            .withColumn("_kind", kinds)
            .select(
                F.col("p_partkey").alias("product_id"),
                F.date_add(F.make_date("_year", F.lit(3), F.lit(1)), shift).alias("start_date"),
                F.date_add(F.make_date("_year", F.lit(6), F.lit(1)), shift).alias("end_date"),
                (F.lit(0.05) + 0.05 * F.col("_kind")).cast("decimal(4,2)").alias("discount_pct"),
            )
        )

    def order_lines(self) -> DataFrame:
        listed = _money("p_retailprice", "decimal(8,2)")
        price = (
            F.when(F.col("l_linenumber") == 1, None)
            .when(F.col("l_orderkey") % 17 == 0, F.lit(0))
            .when(F.col("l_orderkey") % 5 == 0, listed * F.lit(2.5).cast("decimal(2,1)"))
            .otherwise(listed)
        )
        return (
            self._order_lines_of_parts("p_retailprice")
            .select(
                F.col("l_orderkey").alias("order_id"),
                F.col("l_partkey").alias("product_id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("l_shipdate").alias("order_date"),
                _money("l_quantity", "decimal(9,2)").alias("quantity"),
                price.cast("decimal(12,5)").alias("unit_price"),
                "l_linenumber",
                "l_suppkey",
                "l_extendedprice",
            )
        )

    def sales(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("sale_id"),
            F.col("o_custkey").alias("customer_id"),
            (F.col("o_orderkey") % 200).alias("product_id"),
            F.col("o_orderdate").alias("sale_date"),
            F.col("o_orderpriority").alias("category"),
            _money("o_totalprice").alias("amount"),
        )

    def claims(self) -> DataFrame:
        later = (F.col("o_orderkey") % 400 + 7 * F.col("_copy")).cast("int")
        return (
            self.table("orders")
            .withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
            # Claims on urgent orders were entered twice.
            .filter((F.col("_copy") == 0) | (F.col("o_orderpriority") == "1-URGENT"))
            .select(
                F.col("o_orderkey").alias("claim_id"),
                F.col("o_orderkey").alias("sale_id"),
                (F.col("o_orderdate") + F.make_dt_interval(days=later)).alias("claim_date"),
                (_money("o_totalprice") * F.lit(0.1).cast("decimal(2,1)")).alias("claim_cost"),
            )
        )

    def order_headers(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_date"),
            _money("o_totalprice").alias("total_due"),
            (F.col("o_orderkey") % 2).cast("int").alias("online_flag"),
        )

    def brand_lines(self) -> DataFrame:
        return (
            self._order_lines_of_parts("p_brand")
            .select(
                (F.col("o_custkey") % 50).alias("id_cliente"),
                F.col("p_brand").alias("marca"),
                F.col("l_orderkey").alias("id_venda"),
                F.col("o_orderdate").alias("order_date"),
                _money("l_quantity").alias("qty"),
                _money("l_extendedprice").alias("valor_item"),
            )
        )
