from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from chronoloom.operators import checks, compose, lookup, periods
from chronoloom.operators.rolling import (
    deviates,
    drop_vs_prev,
    exceeds,
    recovery_vs_prev,
    trailing_mean,
    trailing_sum,
)
from chronoloom.operators.sequence import had_before, inactivity_intervals, monotone_run
from chronoloom.operators.timeline import Timeline
from chronoloom.plans import brands, churn, contracts, customers, orders, usage
from chronoloom.sources.inputs import Inputs


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# -- sequence ---------------------------------------------------------------------------------


def line(spark, values, part=1):
    df = spark.createDataFrame(
        [(part, i, v) for i, v in enumerate(values)], "k int, t int, v int"
    )
    return Timeline.bounded(df, ["k"], ["t"])


def test_monotone_run(spark):
    up = monotone_run(line(spark, [1, 2, 3, 3, 4, 5]), "v", ["a", "b"], "up")
    assert [r.up for r in up.rows().orderBy("t").collect()] == [0, 0, 1, 0, 0, 1]
    down = monotone_run(line(spark, [3, 2, 1, None, 0]), "v", ["a", "b"], "down", "down")
    assert [r.down for r in down.rows().orderBy("t").collect()] == [0, 0, 1, 0, 0]


def test_had_before_excludes_the_current_row(spark):
    found = had_before(line(spark, [0, 1, 0]), "v", "before").rows().orderBy("t")
    assert [r.before for r in found.collect()] == [None, 0, 1]


def test_inactivity_intervals(spark):
    events = spark.sql(
        "select 1 c, cast(d as timestamp_ntz) t, i from values"
        " ('2024-01-01 23:00:00', 1), ('2024-01-02 01:00:00', 2), ('2024-03-01', 3) as v(d, i)"
    )
    found = inactivity_intervals(
        events, "c", "t", ["i"], began="b", resumed="r", days="d", following="f"
    )
    assert [(r.d, r.f is None) for r in found.orderBy("b").collect()] == [(1, False), (59, True)]


def test_pause_of_exactly_the_limit_is_churn_but_no_return(spark):
    events = spark.sql(
        "select 1 customer_id, cast(d as timestamp_ntz) event_date from values"
        " ('2024-01-01'), ('2024-01-31'), ('2024-03-02') as v(d)"
    )
    found = churn.churn_gap_episodes(events, ordered=True).collect()
    assert [(r.dias_sem_atividade, r.flag_churn, r.flag_reativado) for r in found] == [
        (30, 1, 0), (31, 1, 1),
    ]
    assert found[0].data_churn == date(2024, 1, 31)


# -- rolling ----------------------------------------------------------------------------------


def test_trailing_frames(spark):
    found = line(spark, [1, 2, None, 4]).neighbours(
        lambda w: {"m": trailing_mean("v", 2, w), "s": trailing_sum("v", 3, w)}, back=2
    )
    assert [(r.m, r.s) for r in found.rows().orderBy("t").collect()] == [
        (None, 1), (1.0, 3), (1.5, 3), (2.0, 6),
    ]


def test_thresholds_are_inclusive_where_stated(spark):
    df = spark.sql(
        "select * from values (30, 100), (31, 100), (80, 100), (10, 0), (10, cast(null as int))"
        " as t(v, p)"
    )
    found = df.select(
        drop_vs_prev("v", "p", 0.30), recovery_vs_prev("v", "p", 0.80),
        drop_vs_prev("v", "p", 0.30, positive_only=False),
    ).collect()
    assert [tuple(r) for r in found] == [
        (1, 0, 1), (0, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 0),
    ]


def test_deviation_and_excess(spark):
    df = spark.sql("select * from values (112, 100), (113, 100), (87, 100), (9, null) as t(v, b)")
    found = df.select(deviates("v", "b", 0.12), exceeds("v", "b", 1.12)).collect()
    assert [tuple(r) for r in found] == [(0, 0), (1, 1), (1, 0), (0, 0)]


# -- periods ----------------------------------------------------------------------------------


def activity(spark):
    return spark.sql(
        "select c, cast(d as timestamp_ntz) t from values (1, '2024-01-15'), (1, '2024-01-20'),"
        " (1, '2024-03-01'), (2, '2024-04-30 23:00:00'), (3, null) as v(c, d)"
    )


def test_calendar_per_entity_and_global(spark):
    per = rows(periods.calendar_spine(activity(spark), "c", "t").drop("left"), "c", 2)
    assert [(c, str(m), a) for c, m, a in per] == [
        (1, "2024-01-01", 1), (1, "2024-02-01", 0), (1, "2024-03-01", 1), (2, "2024-04-01", 1),
    ]
    dense = periods.calendar_spine(activity(spark), "c", "t", scope="global")
    assert dense.groupBy("c").count().collect()[0]["count"] == 4
    assert dense.count() == 12


def test_activity_is_kept_as_runs_of_months(spark, capsys):
    months = [(1, f"20{m // 12 + 10}-{m % 12 + 1:02}-15") for m in [0, 1, 2, 5, 6, 9, 23, 24] * 2]
    df = spark.createDataFrame([*months, (2, None)], "c int, t string").selectExpr("c", "cast(t as timestamp_ntz) t")
    found = {r.c: [(str(x["from"]), str(x["to"])) for x in r["_runs"]] for r in periods.activity_runs(df, "c", "t").collect()}
    assert found == {
        1: [("2010-01-01", "2010-03-01"), ("2010-06-01", "2010-07-01"), ("2010-10-01", "2010-10-01"),
            ("2011-12-01", "2012-01-01")],
        2: [],
    }
    grid = periods.calendar_spine(df, "c", "t", scope="global")
    left = {(r.c, str(r.month_start)) for r in grid.collect() if r.left}
    assert left == {(1, "2010-04-01"), (1, "2010-08-01"), (1, "2010-11-01")}
    assert grid.count() == 50 and grid.filter("active = 1").count() == 8
    capsys.readouterr()
    grid.explain()
    assert "Window" not in capsys.readouterr().out


def test_churn_is_the_first_month_without_activity(spark):
    found = rows(churn.calendar_churn(activity(spark), key="c", ts="t"), "c", "month_start")
    assert [(c, a, x) for c, _, a, x in found] == [
        (1, 1, 0), (1, 0, 1), (1, 1, 0), (1, 0, 1),
        (2, 0, 0), (2, 0, 0), (2, 0, 0), (2, 1, 0),
        (3, 0, 0), (3, 0, 0), (3, 0, 0), (3, 0, 0),
    ]


def test_recency_filter_leaves_the_reference_date(spark):
    found = churn.churn_recency(activity(spark), key="c", ts="t", only=F.col("c") == 1)
    assert [(r.dias_sem_compra, r.flag_churn) for r in found.collect()] == [(60, 1)]


# -- usage ------------------------------------------------------------------------------------


def test_rolled_up_and_raw_usage_agree(spark, small):
    events = Inputs(spark, small).feature_usage()
    monthly = periods.monthly_rollup(
        events, ["customer_id"], "event_date", [F.count(F.lit(1)).alias("eventos_mes")]
    )
    raw = usage.usage_drop_run_raw(events)
    rolled = usage.usage_drop_run(monthly).withColumnRenamed(
        "eventos_periodo", "uso_acumulado_periodo"
    )
    assert raw.exceptAll(rolled).isEmpty() and rolled.exceptAll(raw).isEmpty()


def test_cross_feature_overrides(spark):
    events = spark.sql(
        "select 1 customer_id, cast(d as timestamp_ntz) event_time, f feature_name from values"
        " ('2024-01-01', 'export'), ('2024-01-02', 'upload'), ('2024-02-01', 'export'),"
        " ('2024-02-02', 'export'), ('2024-03-01', 'upload'), ('2024-04-01', 'export'),"
        " ('2024-04-01', 'other') as v(d, f)"
    )
    found = rows(usage.feature_drop_cross(events), "month_start")
    # Churn by the upload of January, then by the drop in April; both later months recovered or
    # had an upload in the export month before.
    assert [r[2:] for r in found] == [(1, None, 1, 0), (2, 1, 0, 1), (1, 2, 1, 0)]


def test_customer_without_use_keeps_a_row(spark):
    found = usage.product_usage_risk(
        spark.sql("select * from values (1), (2), (2) as t(customer_id)"),
        spark.sql("select 2 customer_id, 7 product_id, date'2024-01-05' usage_date, 3 usage_count"),
        spark.sql("select 7 product_id"),
    )
    assert [(r.customer_id, r.product_id, r.uso_mes) for r in found.orderBy("customer_id").collect()
            ] == [(1, None, None), (2, 7, 6)]


def test_unlisted_products_count_together(spark):
    used = spark.sql(
        "select 1 customer_id, p product_id, date'2024-01-05' usage_date, n usage_count"
        " from values (7, 3), (8, 4), (9, 5), (null, 1) as t(p, n)"
    )
    found = usage.product_usage_risk(
        spark.sql("select 1 customer_id"), used, spark.sql("select * from values (7), (7) as t(product_id)")
    )
    assert {(r.product_id, r.uso_mes) for r in found.collect()} == {(7, 6), (None, 10)}


# -- compose ----------------------------------------------------------------------------------


def test_merge_metrics_is_a_full_outer_join(spark):
    a = spark.sql("select * from values (1, 5), (1, 6), (null, 1) as t(k, x)")
    b = spark.sql("select * from values (2, 7), (1, 1), (null, 2) as t(k, y)")
    c = spark.sql("select * from values (3, 9), (1, null) as t(k, z)")
    merged = compose.merge_metrics(
        [(a, {"x": F.col("x")}), (b, {"y": F.col("y")}), (c, {"z": F.col("z")})], ["k"]
    )
    assert set(rows(merged, "k")) == {
        (1, 11, 1, None), (2, None, 7, None), (3, None, None, 9),
        (None, 1, None, None), (None, None, 2, None),
    }
    assert merged.count() == 5


def test_share_and_rank(spark):
    df = spark.sql("select * from values (1, 'a', 30), (1, 'b', 10), (1, 'c', 10) as t(g, c, v)")
    found = rows(compose.share_and_rank(df, ["g"], "v", "place", "total", "share"), "c")
    assert [r[3:] for r in found] == [(50, 1, 60.0), (50, 2, 20.0), (50, 2, 20.0)]


def test_top_category_breaks_ties_by_name(spark):
    df = spark.sql("select * from values (1, 'b', 5), (1, 'a', 5), (1, 'c', 4) as t(k, c, v)")
    assert df.groupBy("k").agg(compose.top_category("c", "v")).first()[1] == "a"


def test_top_category_puts_unknown_amounts_last(spark):
    df = spark.sql("select * from values (1, 'a', 5), (1, 'z', null), (2, 'y', null) as t(k, c, v)")
    found = df.groupBy("k").agg(compose.top_category("c", "v").alias("c")).orderBy("k").collect()
    assert [r.c for r in found] == ["a", "y"]


def test_prices_and_bands(spark):
    df = spark.sql(
        "select * from values (null, 7), (0, 7), (-1, 7), (3, 7), (null, null) as t(p, f)"
    )
    found = df.select(
        compose.resolve_price("p", "f"),
        compose.band_label("p", "f", 0.5, 1.8),
    ).collect()
    assert [tuple(r) for r in found] == [
        (7, "OK"), (7, "SUSPEITO"), (7, "SUSPEITO"), (3, "SUSPEITO"), (None, "OK"),
    ]


def test_group_totals_with_and_without_broadcast(spark, monkeypatch):
    df = spark.sql("select * from values (1, 2), (1, 3), (null, 4) as t(g, v)")
    for limit in (100, 0):
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", limit)
        found = compose.with_group_totals(df, ["g"], {"s": F.sum("v"), "m": F.max("v")})
        assert rows(found, "v") == [(1, 2, 5, 3), (1, 3, 5, 3), (None, 4, 4, 4)]


def test_metrics_rollup(spark):
    df = spark.sql("select * from values ('a', 1), ('a', null), ('b', 4) as t(d, v)")
    assert rows(compose.metrics_rollup(df, ["d"], "v"), "d") == [("a", 1, 1.0, 2), ("b", 4, 4.0, 1)]


# -- jobs on hand-made rows -------------------------------------------------------------------


def test_two_cancellations_in_a_month_give_two_rows(spark):
    logs = spark.sql(
        "select * from values (1, 1, timestamp_ntz'2024-01-31', 5),"
        " (1, 1, timestamp_ntz'2024-01-30', 9), (2, 1, timestamp_ntz'2024-03-02', 7)"
        " as t(log_id, customer_id, log_date, duration_minutes)"
    )
    gone = spark.sql(
        "select * from values (1, date'2024-03-01'), (1, date'2024-03-09'), (2, date'2024-01-01')"
        " as t(customer_id, cancel_date)"
    )
    found = rows(contracts.subscription_churn_risk(logs, gone), "customer_id", "mes")
    assert [(r[0], str(r[1]), *r[2:]) for r in found] == [
        (1, "2024-01-01", 5, 1, None, 0, 1),
        (1, "2024-03-01", 7, 1, 30, 1, 0),
        (1, "2024-03-01", 7, 1, 30, 1, 0),
        (2, "2024-01-01", None, None, None, 1, 0),
    ]


def test_subscription_counts_to_the_end_of_its_first_month(spark):
    subs = spark.sql(
        "select * from values (1, 1, date'2024-01-30', date'2024-06-01'),"
        " (2, 1, date'2024-01-30', date'2024-02-01'), (3, 1, date'2024-01-10', date'2024-01-11')"
        " as t(subscription_id, customer_id, start_date, end_date)"
    )
    none = spark.sql("select 1 customer_id, timestamp_ntz'2024-02-01' event_time")
    bills = spark.sql(
        "select 1 customer_id, date'2024-02-01' invoice_date, 10 amount, 'open' status"
    )
    found = rows(contracts.subscription_activity(subs, none, bills), "mes")
    assert [r[2:] for r in found] == [(4, None, None, 0), (None, 1, None, 1)]


def test_customer_360_keeps_customers_without_sales(spark):
    people = spark.sql("select * from values (1, 'x'), (2, 'y') as t(customer_id, country)")
    sales = spark.sql(
        "select * from values (1, timestamp_ntz'2024-01-05', 'a', 10),"
        " (1, timestamp_ntz'2023-01-05', 'b', 4) as t(customer_id, sale_date, category, amount)"
    )
    found = customers.customer_360(people, sales, as_of=F.lit("2024-07-04").cast("date"))
    got = {(r.customer_id, str(r.mes)): r for r in found.collect()}
    assert set(got) == {(1, "2024-01-01"), (1, "2023-01-01"), (2, "None")}
    assert got[1, "2024-01-01"].churn_flag == 1 and got[1, "2024-01-01"].categoria_favorita == "a"
    assert got[2, "None"].churn_flag is None and got[2, "None"].qtd_compras is None


def test_acceleration_needs_two_shorter_intervals(spark):
    days = [0, 10, 18, 24, 34, 36]
    df = spark.createDataFrame(
        [(i, 1, d, 1) for i, d in enumerate(days)], "order_id int, customer_id int, d int, "
        "online_flag int"
    ).withColumn("order_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    shops = spark.sql("select * from values (1, 5), (2, null) as t(customer_id, person_id)")
    names = spark.sql("select 5 person_id, 'n' customer_name")
    other = df.withColumns({"customer_id": F.lit(2), "order_id": F.col("order_id") + 10})
    both = orders.order_acceleration_panel(df.union(other).drop("d"), shops, names)
    assert {(r.customer_id, r.customer_name) for r in both.collect()} == {(1, "n"), (2, None)}
    found = rows(both.filter("customer_id = 1"), "order_id")
    assert [r[4:] for r in found] == [
        (None, 0, 0, 0), (10, 0, 0, 0), (8, 0, 0, 0), (6, 1, 0, 0), (10, 0, 1, 0), (2, 0, 0, 1),
    ]


# -- checks -----------------------------------------------------------------------------------


def test_compare_totals_shows_missing_keys(spark):
    a = spark.sql("select * from values (1, 5), (2, 6) as t(k, x)")
    b = spark.sql("select * from values (1, 4), (3, 6) as t(k, y)")
    found = rows(checks.compare_totals(a, b, ["k"], "x", "y", "d"), "k")
    assert found == [(1, 5, 4, 1), (2, 6, None, None), (3, None, 6, None)]


def test_violations_are_found(spark, small):
    metrics = brands.brand_metrics(Inputs(spark, small).brand_lines())
    assert brands.brand_checks_flags(metrics).isEmpty()
    wrong = metrics.withColumn("taxa_recompra_flag", F.lit(1))
    expected = metrics.filter("contagem_3meses < 3").count()
    assert brands.brand_checks_flags(wrong).count() == expected > 0


def test_checks_share_one_computation(spark, small, tmp_path):
    lines = Inputs(spark, small).brand_lines()
    found = brands.brand_checks(lines, str(tmp_path / "metrics"))
    assert set(found) == {"total", "ticket", "flags"}
    for name, check in found.items():
        text = check._jdf.queryExecution().executedPlan().toString()
        # Only the independent total reads the lines again.
        assert text.count("lineitem.parquet") == (1 if name == "total" else 0)
    metrics = brands.brand_metrics(lines)
    plain = {
        "total": brands.brand_checks_total(metrics, lines),
        "ticket": brands.brand_checks_ticket(metrics),
        "flags": brands.brand_checks_flags(metrics),
    }
    for name, check in found.items():
        assert sorted(map(str, check.collect())) == sorted(map(str, plain[name].collect()))


def test_ticket_of_zero_is_unknown(spark):
    lines = spark.sql(
        "select 1 id_cliente, 'm' marca, 1 id_venda, timestamp_ntz'2024-01-05' order_date,"
        " 0 qty, 10 valor_item union all"
        " select 2, 'm', 2, timestamp_ntz'2024-01-05', 3, 0"
    )
    metrics = brands.brand_metrics(lines)
    assert [r.ticket_med_marca for r in metrics.collect()] == [None, None]
    assert {r.valida_ticket for r in brands.brand_checks_ticket(metrics).collect()} == {"Erro"}


# -- equivalences -----------------------------------------------------------------------------


def same_rows(a, b):
    return sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(
        map(str, b.select(sorted(b.columns)).collect())
    )


def test_figures_do_not_depend_on_the_match(spark, small):
    """Jobs that leave out a match whose columns they do not use give what they would with it."""
    i, order = Inputs(spark, small), ["l_partkey", "l_suppkey", "l_extendedprice"]
    matched = contracts.resolved_logs(i.subscriptions(), i.usage_logs(), log_order=order)
    assert same_rows(
        contracts.subscription_churn_risk(i.usage_logs(), i.cancellations(), log_order=order),
        contracts.subscription_churn_risk(matched, i.cancellations(), log_order=order),
    )
    sales = i.sales().withColumnRenamed("amount", "sale_price")
    covered = contracts.resolved_claims(i.sales(), i.versions(), i.claims(), version_tie=["price"])
    claims = covered.select(i.claims().columns)
    assert same_rows(
        contracts.warranty_claims(sales, i.claims()), contracts.warranty_claims(sales, claims)
    )


def test_no_facts_have_no_blocks(spark):
    from chronoloom.operators import validity

    facts = spark.sql("select 1 k, date'2024-01-01' d").limit(0)
    versions = spark.sql("select 1 k, date'0001-01-01' start_date, date'9999-12-31' end_date, 5 v")
    found = validity.interval_match_best(
        facts, versions, key="k", at="d", prefer=["v"], take={"v": "v"}
    )
    assert found.count() == 0
