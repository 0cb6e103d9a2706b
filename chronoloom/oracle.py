"""Independent SQL for every registered query, for DuckDB over the same parquet tables.

Written the plain way (self-contained windows and joins), not the way the jobs work, so that
agreement means something. Money is summed as DECIMAL and returned as DOUBLE, means are rounded.
"""

from __future__ import annotations

_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"

INPUTS: dict[str, str] = {
    "customer_events": """
        SELECT o_custkey AS customer_id, o_orderdate AS event_time, o_orderkey AS event_id
        FROM orders""",
    "feature_events": """
        SELECT o_custkey % 20 AS customer_id, o_orderdate AS event_time,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'export'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'upload' ELSE 'other' END AS feature
        FROM orders""",
    "feature_usage": """
        SELECT o_custkey % 50 AS customer_id, o_orderdate AS event_date FROM orders""",
    "customers_dim": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS country
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "product_usage": f"""
        SELECT o_custkey % 50 AS customer_id, l_partkey % 5 - 1 AS product_id,
               l_shipdate AS usage_date, CAST(l_quantity AS DECIMAL(18,2)) AS usage_count
        FROM {_LINES}""",
    "products": "SELECT p_partkey AS product_id, p_name AS product_name FROM part",
    "customer_people": """
        SELECT c_custkey AS customer_id,
               CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS person_id
        FROM customer""",
    "people": "SELECT c_custkey AS person_id, c_name AS customer_name FROM customer",
    "readings": """
        SELECT user_id AS entity_id, ts AS event_time, event_id,
               CAST(value AS DECIMAL(18,2)) AS reading,
               CAST(100 + (event_id * 37 % 100) * 0.5 AS DOUBLE) AS pressure,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS status_code,
               CAST(value AS DECIMAL(18,2)) * 20 AS processing_time_ms,
               CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN NULL ELSE 0 END
                   AS error_count
        FROM events""",
    "seller_daily": """
        SELECT o_custkey % 3 AS seller_id, CAST(o_orderdate AS DATE) AS sale_date,
               count(*) AS total_orders,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total_revenue
        FROM orders GROUP BY ALL""",
    "deliveries": """
        SELECT event_id AS delivery_id, user_id AS driver_id, user_id % 10 AS centre_id,
               'CITY_' || CAST(user_id % 25 AS VARCHAR) AS city, ts AS pickup_ready_at,
               ts + to_minutes(CAST(floor(value) AS BIGINT)) AS out_for_delivery_at,
               ts + to_minutes(CAST(floor(value) + 5 + event_id % 40 AS BIGINT)) AS delivered_at
        FROM events""",
    "fulfilment": """
        SELECT event_id AS order_id, user_id % 20 AS hub_id, ts AS payment_at,
               ts + to_minutes(CAST(floor(value * 3) AS BIGINT)) AS invoice_at,
               ts + to_minutes(CAST(floor(value * 2) AS BIGINT)) AS packed_at,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS priority_flag
        FROM events""",
    "subscriptions": """
        SELECT o_orderkey AS subscription_id, o_custkey AS customer_id,
               CAST(o_orderdate AS DATE) AS start_date,
               CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 60 AS INT) AS end_date,
               CAST(o_totalprice AS DECIMAL(18,2)) AS monthly_fee
        FROM orders""",
    "usage_logs": f"""
        SELECT l_orderkey * 8 + l_linenumber AS log_id, o_custkey AS customer_id,
               l_shipdate AS log_date, l_returnflag AS feature,
               CAST(l_quantity AS DECIMAL(18,2)) AS duration_minutes,
               l_partkey, l_suppkey, l_extendedprice
        FROM {_LINES}""",
    "cancellations": """
        SELECT o_custkey AS customer_id, o_orderdate AS cancel_date
        FROM orders WHERE o_orderstatus = 'F'""",
    "invoices": """
        SELECT o_custkey AS customer_id, o_orderdate AS invoice_date,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
               CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'paid' END AS status
        FROM orders""",
    "versions": """
        SELECT p_partkey AS product_id, make_date(y, 1, 1) AS start_date,
               make_date(y, 1, 1) + CAST(380 + 30 * v AS INT) AS end_date,
               CAST(CAST(p_retailprice AS DECIMAL(8,2))
                    * CAST(1 + 0.02 * (y - 1995) AS DECIMAL(4,2))
                    * CAST(1 + 0.1 * v AS DECIMAL(3,1)) AS DECIMAL(12,5)) AS price,
               CASE WHEN v = 1 THEN 'plus' ELSE 'base' END AS coverage_level,
               p_partkey % 100 AS customer_id
        FROM part, (VALUES (1996), (1997), (1998), (1999), (2000)) years(y),
             (VALUES (0), (1)) kinds(v)
        WHERE v = 0 OR p_partkey % 10 = 0""",
    "campaigns": """
        SELECT p_partkey AS product_id, make_date(y, 3, 1) + CAST(30 * v AS INT) AS start_date,
               make_date(y, 6, 1) + CAST(30 * v AS INT) AS end_date,
               CAST(0.05 + 0.05 * v AS DECIMAL(4,2)) AS discount_pct
        FROM part, (VALUES (1996), (1998), (2000)) years(y), (VALUES (0), (1)) kinds(v)""",
    "order_lines": f"""
        SELECT l_orderkey AS order_id, l_partkey AS product_id, o_custkey AS customer_id,
               l_shipdate AS order_date, CAST(l_quantity AS DECIMAL(9,2)) AS quantity,
               CAST(CASE WHEN l_linenumber = 1 THEN NULL
                         WHEN l_orderkey % 17 = 0 THEN 0
                         WHEN l_orderkey % 5 = 0 THEN CAST(p_retailprice AS DECIMAL(8,2)) * 2.5
                         ELSE CAST(p_retailprice AS DECIMAL(8,2)) END AS DECIMAL(12,5))
                   AS unit_price,
               l_linenumber, l_suppkey, l_extendedprice
        FROM {_LINES} JOIN part ON l_partkey = p_partkey""",
    "sales": """
        SELECT o_orderkey AS sale_id, o_custkey AS customer_id, o_orderkey % 200 AS product_id,
               o_orderdate AS sale_date, o_orderpriority AS category,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount
        FROM orders""",
    "claims": """
        SELECT o_orderkey AS claim_id, o_orderkey AS sale_id,
               o_orderdate + to_days(CAST(o_orderkey % 400 + 7 * v AS INT)) AS claim_date,
               CAST(o_totalprice AS DECIMAL(18,2)) * 0.1 AS claim_cost
        FROM orders, (VALUES (0), (1)) copies(v)
        WHERE v = 0 OR o_orderpriority = '1-URGENT'""",
    "order_headers": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total_due,
               CAST(o_orderkey % 2 AS INT) AS online_flag
        FROM orders""",
    "brand_lines": f"""
        SELECT o_custkey % 50 AS id_cliente, p_brand AS marca, l_orderkey AS id_venda,
               o_orderdate AS order_date, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS valor_item
        FROM {_LINES} JOIN part ON l_partkey = p_partkey""",
}


def _query(inputs: list[str], body: str) -> str:
    ctes = ", ".join(f"{name} AS ({INPUTS[name]})" for name in inputs)
    body = body.strip()
    joint = ", " if body.startswith("WITH_MORE") else " "
    return f"WITH {ctes}{joint}{body.removeprefix('WITH_MORE')}"


def _month(c: str) -> str:
    return f"CAST(date_trunc('month', {c}) AS DATE)"


def _mean(c: str, rows: int, window: str) -> str:
    before = f"OVER ({window} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    return f"CAST(sum({c}) {before} AS DOUBLE) / nullif(count({c}) {before}, 0)"


_ENTITY = "PARTITION BY entity_id ORDER BY event_time, event_id"


def _islands(looked: str, flags: str, start: str, summary: str, keep: str, anomalous: str) -> str:
    """looked: columns from windows; flags: a and g; start: new island; then group and filter."""
    return _query(
        ["readings"],
        f"""WITH_MORE looked AS (SELECT *, lag(event_time) OVER w AS t0, {looked} FROM readings
                                 WINDOW w AS ({_ENTITY})),
        flagged AS (SELECT *, {flags} FROM looked),
        compared AS (SELECT *, lag(a) OVER ({_ENTITY}) AS a0 FROM flagged),
        numbered AS (SELECT *, CAST(sum(CASE WHEN {start} THEN 1 ELSE 0 END) OVER ({_ENTITY}
                         ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grupo_id FROM compared)
        SELECT entity_id, grupo_id, {summary} FROM numbered {anomalous}
        GROUP BY entity_id, grupo_id HAVING {keep}""",
    )


def _gap(unit: str, limit: int) -> str:
    return f"date_diff('{unit}', t0, event_time) > {limit}"


def _delays(source: str, entity: str, ts: str, key: str, delay: str, limit: int, gap: int,
            extra_keys: str, summary: str, keep: str, known_only: bool = False) -> str:
    """Onset islands of rows whose delay in minutes is above the limit."""
    order = f"PARTITION BY {entity} ORDER BY {ts}, {key}"
    normal_before = f"d0 <= {limit}" if known_only else f"coalesce(d0 <= {limit}, true)"
    return _query(
        [source],
        f"""WITH_MORE timed AS (SELECT *, {delay} AS d FROM {source}),
        looked AS (SELECT *, lag(d) OVER o AS d0, lag({ts}) OVER o AS t0 FROM timed
                   WINDOW o AS ({order})),
        numbered AS (
            SELECT *, sum(CASE WHEN d > {limit} AND (t0 IS NULL OR {normal_before}
                               OR date_diff('minute', t0, {ts}) > {gap}) THEN 1 ELSE 0 END)
                      OVER ({order} ROWS UNBOUNDED PRECEDING) AS island
            FROM looked)
        SELECT {summary} FROM numbered WHERE d > {limit}
        GROUP BY {entity}, {extra_keys} island HAVING {keep}""",
    )


def _monthly_drop(total: str, factor: str, counted: str, extra: str = "") -> str:
    return _query(
        ["feature_usage"],
        f"""WITH_MORE per_month AS (
            SELECT customer_id, {_month('event_date')} AS month_start, count(*) AS eventos_mes
            FROM feature_usage GROUP BY ALL),
        prior AS (SELECT *, lag(eventos_mes) OVER w AS eventos_mes_anterior FROM per_month
                  WINDOW w AS (PARTITION BY customer_id ORDER BY month_start)),
        flagged AS (SELECT *, CAST(coalesce(eventos_mes <=
                        CAST(eventos_mes_anterior AS DOUBLE) * CAST({factor} AS DOUBLE), false)
                        AS INT) AS flag_evento FROM prior),
        compared AS (SELECT *, lag(flag_evento) OVER w AS f0 FROM flagged
                     WINDOW w AS (PARTITION BY customer_id ORDER BY month_start))
        SELECT customer_id, month_start, eventos_mes, eventos_mes_anterior, flag_evento,
               CASE WHEN flag_evento = 1 AND coalesce(f0, 0) = 0 THEN 1 ELSE 0 END
                   AS inicio_periodo, {extra}
               CAST(sum(CASE WHEN {counted} THEN eventos_mes ELSE 0 END) OVER (
                   PARTITION BY customer_id ORDER BY month_start ROWS UNBOUNDED PRECEDING)
                   AS BIGINT) AS {total}
        FROM compared""",
    )


def _feature(drop: str, crossed: bool) -> str:
    up = f"(SELECT DISTINCT customer_id, {_month('event_time')} FROM feature_events " \
         "WHERE feature = 'upload')"
    now = f" OR (customer_id, month_start) IN {up}" if crossed else ""
    before = f" OR coalesce((customer_id, m0) IN {up}, false)" if crossed else ""
    return _query(
        ["feature_events"],
        f"""WITH_MORE per_month AS (
            SELECT customer_id, {_month('event_time')} AS month_start, count(*) AS eventos_mes
            FROM feature_events WHERE feature = 'export' GROUP BY ALL),
        prior AS (SELECT *, lag(eventos_mes) OVER w AS eventos_mes_anterior,
                         lag(month_start) OVER w AS m0
                  FROM per_month WINDOW w AS (PARTITION BY customer_id ORDER BY month_start)),
        n AS (SELECT *, CAST(eventos_mes_anterior AS DOUBLE) AS p FROM prior)
        SELECT customer_id, month_start, eventos_mes, eventos_mes_anterior,
               CASE WHEN (p > 0 AND eventos_mes <= p * CAST({drop} AS DOUBLE)){now}
                    THEN 1 ELSE 0 END AS flag_churn,
               CASE WHEN (p > 0 AND eventos_mes >= p * CAST(0.8 AS DOUBLE)){before}
                    THEN 1 ELSE 0 END AS flag_reativado
        FROM n""",
    )


def _pauses(columns: str) -> str:
    return _query(
        ["customer_events"],
        f"""WITH_MORE pairs AS (
            SELECT customer_id, event_time, lag(event_time) OVER w AS e0,
                   lead(event_time) OVER w AS e1,
                   date_diff('day', lag(event_time) OVER w, event_time) AS days
            FROM customer_events
            WINDOW w AS (PARTITION BY customer_id ORDER BY event_time, event_id))
        SELECT customer_id, {columns} FROM pairs WHERE e0 IS NOT NULL AND days >= 30""",
    )


_LOGS_ONCE = """logs AS (SELECT * FROM usage_logs QUALIFY row_number() OVER (
    PARTITION BY log_id ORDER BY log_date DESC NULLS LAST, l_partkey, l_suppkey,
    l_extendedprice) = 1)"""
_SUBS_ONCE = """subs AS (SELECT * FROM subscriptions QUALIFY row_number() OVER (
    PARTITION BY customer_id, start_date
    ORDER BY end_date DESC NULLS LAST, subscription_id DESC) = 1)"""
_VERSIONS_ONCE = """clean AS (SELECT * FROM versions QUALIFY row_number() OVER (
    PARTITION BY product_id, start_date ORDER BY end_date DESC NULLS LAST, price DESC) = 1)"""
_CLAIMS_ONCE = """once AS (SELECT * FROM claims QUALIFY row_number() OVER (
    PARTITION BY claim_id ORDER BY claim_date DESC NULLS LAST) = 1)"""

_BRANDS = f"""WITH_MORE cells AS (
        SELECT id_cliente, marca, CAST(year(order_date) AS INT) AS ano,
               CAST(month(order_date) AS INT) AS mes,
               sum(valor_item) AS spend, count(DISTINCT id_venda) AS sales_count,
               nullif(CAST(sum(valor_item) AS DOUBLE) / nullif(CAST(sum(qty) AS DOUBLE), 0), 0)
                   AS ticket,
               count(*) AS line_count,
               date_diff('day', CAST(max(order_date) AS DATE), last_day(max(order_date)))
                   AS recencia
        FROM brand_lines GROUP BY ALL),
    trailed AS (
        SELECT *, {_mean('ticket', 3, 'PARTITION BY id_cliente, marca ORDER BY ano, mes')} AS m3,
               CAST(sum(line_count) OVER (PARTITION BY id_cliente, marca ORDER BY ano, mes
                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS c3
        FROM cells),
    months AS (SELECT id_cliente, ano, mes, sum(spend) AS month_spend FROM trailed GROUP BY ALL),
    metrics AS (
        SELECT t.id_cliente, t.marca, t.ano, t.mes, CAST(spend AS DOUBLE) AS total_mes_marca,
               spend, sales_count AS freq_marca,
               round(CAST(spend AS DOUBLE) / CAST(month_spend AS DOUBLE) * 100, 6)
                   AS part_pct_marca,
               recencia, round(ticket, 6) AS ticket_med_marca, ticket, round(m3, 6) AS media_3m,
               m3, c3 AS contagem_3meses,
               CASE WHEN c3 = 3 THEN 1 ELSE 0 END AS taxa_recompra_flag,
               CASE WHEN CAST(spend AS DOUBLE) > m3 * CAST(1.5 AS DOUBLE) THEN 1 ELSE 0 END
                   AS flag_explosao,
               rank() OVER (PARTITION BY t.id_cliente, t.ano, t.mes ORDER BY spend DESC)
                   AS rank_cliente_marca
        FROM trailed t JOIN months f
          ON t.id_cliente = f.id_cliente AND t.ano = f.ano AND t.mes = f.mes)"""

_BRAND_COLUMNS = """id_cliente, marca, ano, mes, total_mes_marca, freq_marca, part_pct_marca,
    recencia, ticket_med_marca, media_3m, contagem_3meses, taxa_recompra_flag, flag_explosao,
    rank_cliente_marca"""


def _order_steps(body: str) -> str:
    w = "PARTITION BY customer_id ORDER BY order_date, order_id"
    return _query(
        ["order_headers", "customer_people", "people"],
        f"""WITH_MORE dated AS (
            SELECT h.*, p.customer_name,
                   lag(order_date) OVER (PARTITION BY h.customer_id ORDER BY order_date, order_id)
                       AS before
            FROM order_headers h JOIN customer_people c ON h.customer_id = c.customer_id
                 LEFT JOIN people p ON c.person_id = p.person_id),
        spaced AS (SELECT *, date_diff('day', before, order_date) AS gap FROM dated),
        compared AS (SELECT *, lag(gap) OVER w AS gap1, lag(gap, 2) OVER w AS gap2 FROM spaced
                     WINDOW w AS ({w})) {body}""",
    ).replace("@W", w)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # -- churn
    q["churn_recency"] = _query(
        ["customer_events"],
        """SELECT customer_id, max(event_time) AS ultima_data_compra,
               date_diff('day', max(event_time), last_day(
                   (SELECT max(event_time) FROM customer_events))) AS dias_sem_compra,
               CASE WHEN date_diff('day', max(event_time), last_day(
                   (SELECT max(event_time) FROM customer_events))) > 30
                    THEN 1 ELSE 0 END AS flag_churn
           FROM customer_events GROUP BY customer_id""",
    )
    q["churn_gap_episodes"] = _pauses(
        """e0 AS data_inicio_inatividade, CAST(e0 AS DATE) + 30 AS data_churn,
           days AS dias_sem_atividade, 1 AS flag_churn,
           CASE WHEN days > 30 THEN 1 ELSE 0 END AS flag_reativado"""
    )
    q["churn_gap_reactivation"] = _pauses(
        """e0 AS inicio_inatividade, event_time AS evento_churn,
           CAST(e0 AS DATE) + 30 AS data_churn, days AS dias_sem_atividade, 1 AS flag_churn,
           CASE WHEN e1 IS NULL THEN 0 ELSE 1 END AS flag_reativado, e1 AS data_reativacao"""
    )
    q["calendar_churn"] = _query(
        ["customer_events"],
        f"""WITH_MORE active AS (
                SELECT DISTINCT customer_id, {_month('event_time')} AS m FROM customer_events),
            months AS (SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH))
                           AS DATE) AS month_start FROM active),
            grid AS (SELECT customer_id, month_start
                     FROM (SELECT DISTINCT customer_id FROM active), months),
            states AS (SELECT g.customer_id, month_start,
                              CASE WHEN m IS NULL THEN 0 ELSE 1 END AS ativo
                       FROM grid g LEFT JOIN active a
                         ON a.customer_id = g.customer_id AND a.m = month_start)
            SELECT *, CASE WHEN ativo = 0 AND lag(ativo) OVER (
                          PARTITION BY customer_id ORDER BY month_start) = 1
                      THEN 1 ELSE 0 END AS churn FROM states""",
    )
    q["customer_calendar"] = _query(
        ["customer_events"],
        f"""SELECT customer_id, CAST(unnest(generate_series({_month('min(event_time)')},
                {_month('max(event_time)')}, INTERVAL 1 MONTH)) AS DATE) AS month_start
            FROM customer_events GROUP BY customer_id""",
    )

    # -- monthly usage
    q["feature_drop"] = _feature("0.3", crossed=False)
    q["feature_drop_cross"] = _feature("0.7", crossed=True)
    q["usage_drop_run"] = _monthly_drop("eventos_periodo", "0.7", "flag_evento = 1")
    q["usage_drop_run_raw"] = _monthly_drop("uso_acumulado_periodo", "0.7", "flag_evento = 1")
    q["usage_drop_severe"] = _monthly_drop(
        "uso_acumulado_periodo", "0.6", "flag_evento = 1 AND f0 = 0",
        """CASE WHEN flag_evento = 1 AND eventos_mes <= CAST(eventos_mes_anterior AS DOUBLE)
               * CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END AS flag_reativacao,""",
    )
    q["product_usage_risk"] = _query(
        ["customers_dim", "product_usage", "products"],
        f"""WITH_MORE used AS (
                SELECT c.customer_id, p.product_id, {_month('u.usage_date')} AS month_start,
                       sum(u.usage_count) AS n
                FROM customers_dim c LEFT JOIN product_usage u ON c.customer_id = u.customer_id
                     LEFT JOIN products p ON u.product_id = p.product_id
                GROUP BY ALL),
            prior AS (SELECT *, lag(n) OVER (PARTITION BY customer_id, product_id
                                             ORDER BY month_start) AS n0 FROM used)
            SELECT customer_id, product_id, month_start, CAST(n AS DOUBLE) AS uso_mes,
                   CAST(n0 AS DOUBLE) AS uso_mes_anterior,
                   round(CAST(n - n0 AS DOUBLE) * 100 / nullif(CAST(n0 AS DOUBLE), 0), 6)
                       AS pct_variacao,
                   CASE WHEN n0 > 0 AND CAST(n AS DOUBLE) <= CAST(n0 AS DOUBLE)
                             * CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END AS flag_risco
            FROM prior""",
    )

    # -- validity intervals
    matched_logs = f"""WITH_MORE {_LOGS_ONCE}, {_SUBS_ONCE}, matched AS (
        SELECT l.*, s.subscription_id, s.monthly_fee
        FROM logs l LEFT JOIN subs s
          ON l.customer_id = s.customer_id AND l.log_date BETWEEN s.start_date AND s.end_date
        QUALIFY row_number() OVER (PARTITION BY l.log_id
            ORDER BY s.end_date DESC NULLS LAST, s.start_date DESC NULLS LAST) = 1)"""
    q["resolved_logs"] = _query(
        ["usage_logs", "subscriptions"],
        f"""{matched_logs} SELECT log_id, customer_id, log_date, feature,
            CAST(duration_minutes AS DOUBLE) AS duration_minutes, subscription_id,
            CAST(monthly_fee AS DOUBLE) AS monthly_fee FROM matched""",
    )
    q["subscription_churn_risk"] = _query(
        ["usage_logs", "subscriptions", "cancellations"],
        f"""{matched_logs}, used AS (
            SELECT customer_id, {_month('log_date')} AS mes, sum(duration_minutes) AS minutes,
                   count(DISTINCT CAST(log_date AS DATE)) AS days
            FROM matched GROUP BY ALL),
        idle AS (
            SELECT u.*, date_diff('day', (SELECT max(m.log_date) FROM matched m
                WHERE m.customer_id = u.customer_id AND m.log_date < u.mes), u.mes) AS away
            FROM used u),
        gone AS (SELECT customer_id AS cc, {_month('cancel_date')} AS cm FROM cancellations)
        SELECT coalesce(customer_id, cc) AS customer_id, coalesce(mes, cm) AS mes,
               CAST(minutes AS DOUBLE) AS total_minutes, days AS active_days,
               away AS days_since_last_use,
               CASE WHEN cc IS NULL THEN 0 ELSE 1 END AS churned_month,
               CASE WHEN cc IS NOT NULL THEN 0 WHEN days < 2 OR away > 20 THEN 1 ELSE 0 END
                   AS churn_risk
        FROM idle FULL JOIN gone ON customer_id = cc AND mes = cm""",
    )
    q["subscription_activity"] = _query(
        ["subscriptions", "usage_logs", "invoices"],
        f"""WITH_MORE {_SUBS_ONCE}, a AS (
            SELECT customer_id AS ac, {_month('start_date')} AS am,
                   CAST(sum(least(end_date, last_day(start_date)) - start_date + 1) AS BIGINT)
                       AS dias_ativos
            FROM subs GROUP BY ALL),
        u AS (SELECT customer_id AS uc, {_month('log_date')} AS um, count(*) AS qtd_eventos
              FROM usage_logs GROUP BY ALL),
        b AS (SELECT customer_id AS bc, {_month('invoice_date')} AS bm,
                     CAST(sum(amount) AS DOUBLE) AS receita_mes
              FROM invoices WHERE status = 'paid' GROUP BY ALL)
        SELECT coalesce(ac, uc, bc) AS customer_id, coalesce(am, um, bm) AS mes, dias_ativos,
               qtd_eventos, receita_mes,
               CASE WHEN dias_ativos IS NULL THEN 1 ELSE 0 END AS churn_flag
        FROM a FULL JOIN u ON ac = uc AND am = um
               FULL JOIN b ON coalesce(ac, uc) = bc AND coalesce(am, um) = bm""",
    )
    q["contract_billing"] = _query(
        ["versions", "order_lines"],
        f"""WITH_MORE {_VERSIONS_ONCE}, billed AS (
            SELECT o.order_date, c.customer_id, o.quantity * c.price AS charged
            FROM order_lines o LEFT JOIN clean c
              ON o.product_id = c.product_id AND o.order_date BETWEEN c.start_date AND c.end_date
            QUALIFY row_number() OVER (PARTITION BY o.order_id * 8 + o.l_linenumber
                ORDER BY c.end_date DESC NULLS LAST, c.start_date DESC NULLS LAST,
                         c.customer_id DESC NULLS LAST, c.price DESC NULLS LAST,
                         o.order_date DESC, o.product_id, o.l_suppkey, o.l_extendedprice) = 1)
        SELECT customer_id, {_month('order_date')} AS mes,
               CAST(sum(charged) AS DOUBLE) AS receita_mensal, count(*) AS qtd_faturas
        FROM billed GROUP BY ALL""",
    )
    q["price_anomaly"] = _query(
        ["order_lines", "versions"],
        f"""WITH_MORE {_VERSIONS_ONCE}, lines AS (
            SELECT * FROM order_lines QUALIFY row_number() OVER (PARTITION BY order_id, product_id
                ORDER BY order_date DESC, l_linenumber, l_suppkey, l_extendedprice) = 1),
        priced AS (
            SELECT o.*, CASE WHEN o.unit_price > 0 THEN o.unit_price ELSE c.price END AS fp
            FROM lines o LEFT JOIN clean c
              ON o.product_id = c.product_id AND o.order_date BETWEEN c.start_date AND c.end_date
            QUALIFY row_number() OVER (PARTITION BY o.order_id, o.product_id
                ORDER BY c.end_date DESC NULLS LAST, c.start_date DESC NULLS LAST) = 1),
        means AS (SELECT product_id, CAST(sum(price) AS DOUBLE) / count(price) AS mp
                  FROM clean GROUP BY product_id)
        SELECT order_id, p.product_id, customer_id, order_date,
               CAST(quantity AS DOUBLE) AS quantity, CAST(fp AS DOUBLE) AS final_price,
               CASE WHEN CAST(fp AS DOUBLE) < CAST(0.5 AS DOUBLE) * mp
                      OR CAST(fp AS DOUBLE) > CAST(1.8 AS DOUBLE) * mp
                    THEN 'SUSPEITO' ELSE 'OK' END AS price_flag
        FROM priced p LEFT JOIN means m ON p.product_id = m.product_id""",
    )
    q["resolved_claims"] = _query(
        ["sales", "versions", "claims"],
        f"""WITH_MORE {_VERSIONS_ONCE}, {_CLAIMS_ONCE}
        SELECT c.sale_id, c.claim_id, c.claim_date, CAST(c.claim_cost AS DOUBLE) AS claim_cost,
               s.customer_id, s.product_id, v.coverage_level
        FROM once c LEFT JOIN sales s ON c.sale_id = s.sale_id
             LEFT JOIN clean v ON s.product_id = v.product_id
                              AND c.claim_date BETWEEN v.start_date AND v.end_date
        QUALIFY row_number() OVER (PARTITION BY c.claim_id
            ORDER BY v.end_date DESC NULLS LAST, v.start_date DESC NULLS LAST) = 1""",
    )
    q["warranty_claims"] = _query(
        ["sales", "versions", "claims"],
        f"""WITH_MORE {_VERSIONS_ONCE}, {_CLAIMS_ONCE}, covered AS (
            SELECT s.customer_id, {_month('c.claim_date')} AS mes, c.claim_cost
            FROM once c LEFT JOIN sales s ON c.sale_id = s.sale_id
                 LEFT JOIN clean v ON s.product_id = v.product_id
                                  AND c.claim_date BETWEEN v.start_date AND v.end_date
            QUALIFY row_number() OVER (PARTITION BY c.claim_id
                ORDER BY v.end_date DESC NULLS LAST) = 1),
        sold AS (SELECT customer_id AS sc, {_month('sale_date')} AS sm, count(*) AS n,
                        CAST(sum(amount) AS DOUBLE) AS r FROM sales GROUP BY ALL),
        claimed AS (SELECT customer_id AS cc, mes AS cm, count(*) AS k,
                           CAST(sum(claim_cost) AS DOUBLE) AS cost FROM covered GROUP BY ALL)
        SELECT coalesce(sc, cc) AS customer_id, coalesce(sm, cm) AS mes, n AS produtos_no_mes,
               r AS receita_mes, k AS qtd_claims, cost AS custo_claims
        FROM sold FULL JOIN claimed ON sc = cc AND sm = cm""",
    )
    q["license_usage"] = _query(
        ["usage_logs", "subscriptions", "customers_dim"],
        f"""{matched_logs}
        SELECT m.customer_id, d.country, {_month('m.log_date')} AS mes,
               CAST(sum(duration_minutes) AS DOUBLE) AS total_usage,
               CAST(sum(monthly_fee) AS DOUBLE) AS receita_mes, count(*) AS eventos
        FROM matched m LEFT JOIN customers_dim d ON m.customer_id = d.customer_id
        GROUP BY ALL""",
    )
    q["effective_price"] = _query(
        ["order_lines", "versions", "campaigns"],
        f"""WITH_MORE {_VERSIONS_ONCE}, sold AS (
            SELECT order_id * 8 + l_linenumber AS sale_id, o.product_id, order_date AS sale_date,
                   quantity AS qty, k.discount_pct
            FROM order_lines o LEFT JOIN campaigns k
              ON o.product_id = k.product_id AND o.order_date BETWEEN k.start_date AND k.end_date
            QUALIFY row_number() OVER (PARTITION BY order_id * 8 + l_linenumber
                ORDER BY k.discount_pct DESC NULLS LAST, order_date DESC, o.product_id,
                         l_suppkey, l_extendedprice) = 1)
        SELECT s.sale_id, s.product_id, s.sale_date, CAST(s.qty AS DOUBLE) AS qty,
               CAST(c.price AS DOUBLE) AS price, CAST(s.discount_pct AS DOUBLE) AS discount_pct,
               CAST(s.qty * c.price * (1 - coalesce(s.discount_pct, 0)) AS DOUBLE)
                   AS preco_efetivo
        FROM sold s LEFT JOIN clean c
          ON s.product_id = c.product_id AND s.sale_date BETWEEN c.start_date AND c.end_date
        QUALIFY row_number() OVER (PARTITION BY s.sale_id
            ORDER BY c.start_date DESC NULLS LAST) = 1""",
    )

    # -- customers
    q["customer_360"] = _query(
        ["customers_dim", "sales"],
        f"""WITH_MORE spent AS (
            SELECT customer_id, max(sale_date) AS last_sale, count(*) AS n, sum(amount) AS total,
                   count(amount) AS known FROM sales GROUP BY customer_id),
        liked AS (
            SELECT customer_id, category FROM sales GROUP BY customer_id, category
            QUALIFY row_number() OVER (PARTITION BY customer_id
                ORDER BY sum(amount) DESC NULLS LAST, category) = 1),
        monthly AS (SELECT {_month('sale_date')} AS mes, customer_id, sum(amount) AS spend
                    FROM sales GROUP BY ALL),
        ranked AS (SELECT *, rank() OVER (PARTITION BY mes ORDER BY spend DESC) AS rank_mes
                   FROM monthly)
        SELECT c.customer_id, c.country, s.last_sale AS ultima_compra, s.n AS qtd_compras,
               CAST(s.total AS DOUBLE) AS total_gasto,
               round(CAST(s.total AS DOUBLE) / s.known, 6) AS ticket_medio,
               l.category AS categoria_favorita,
               CASE WHEN s.customer_id IS NULL THEN NULL
                    WHEN s.last_sale < CAST((SELECT max(sale_date) FROM sales) AS DATE) - 180
                    THEN 1 ELSE 0 END AS churn_flag, r.mes, r.rank_mes
        FROM customers_dim c LEFT JOIN spent s ON c.customer_id = s.customer_id
             LEFT JOIN liked l ON c.customer_id = l.customer_id
             LEFT JOIN ranked r ON c.customer_id = r.customer_id""",
    )

    # -- islands
    q["temperature_jumps"] = _query(
        ["readings"],
        """WITH_MORE steps AS (SELECT *, reading - lag(reading) OVER (
               ORDER BY event_time, event_id) AS step FROM readings),
           numbered AS (SELECT *, CAST(sum(CASE WHEN step > 1.5 THEN 1 ELSE 0 END) OVER (
               ORDER BY event_time RANGE UNBOUNDED PRECEDING) AS BIGINT) AS grupo_id FROM steps)
           SELECT grupo_id, min(event_time) AS inicio_periodo, max(event_time) AS fim_periodo,
                  CAST(min(reading) AS DOUBLE) AS temp_min,
                  CAST(max(reading) AS DOUBLE) AS temp_max, count(*) AS total_leituras
           FROM numbered GROUP BY grupo_id""",
    )
    x = "CAST(reading AS DOUBLE)"
    q["terminal_instability"] = _islands(
        "CAST(lag(reading) OVER w AS DOUBLE) AS x0",
        f"""CASE WHEN status_code <> 0 OR {x} >= x0 * CAST(1.3 AS DOUBLE) THEN 1 ELSE 0 END AS a,
            CASE WHEN t0 IS NULL OR {_gap('minute', 1440)} THEN 1 ELSE 0 END AS g""",
        "g = 1 OR a = 0",
        """min(event_time) AS inicio_periodo, max(event_time) AS fim_periodo,
           date_diff('minute', min(event_time), max(event_time)) AS duracao_minutos,
           count(*) AS qtd_leituras, CAST(sum(a) AS BIGINT) AS qtd_instaveis,
           CAST(max(reading) AS DOUBLE) AS max_latency""",
        "date_diff('minute', min(event_time), max(event_time)) >= 10 AND sum(a) >= 2",
        "WHERE a = 1",
    )
    q["node_instability"] = _islands(
        "CAST(lag(reading) OVER w AS DOUBLE) AS x0",
        f"""CASE WHEN status_code > 0 OR {x} > x0 * CAST(1.4 AS DOUBLE) THEN 1 ELSE 0 END AS a,
            CASE WHEN t0 IS NULL OR {_gap('minute', 1440)} THEN 1 ELSE 0 END AS g""",
        "a = 1 OR g = 1",
        """min(event_time) AS inicio, max(event_time) AS fim,
           date_diff('minute', min(event_time), max(event_time)) AS minutos,
           max(status_code) AS pior_status, CAST(max(reading) AS DOUBLE) AS max_lat""",
        "date_diff('minute', min(event_time), max(event_time)) >= 0",
        "WHERE a = 1",
    )
    q["device_irregular"] = _islands(
        f"{_mean('reading', 3, _ENTITY)} AS mt, {_mean('pressure', 4, _ENTITY)} AS mp",
        f"""CASE WHEN abs({x} - mt) > mt * CAST(0.15 AS DOUBLE) THEN 1 ELSE 0 END AS off_t,
            CASE WHEN abs(pressure - mp) > mp * CAST(0.10 AS DOUBLE) THEN 1 ELSE 0 END AS off_p,
            CASE WHEN abs({x} - mt) > mt * CAST(0.15 AS DOUBLE)
                   OR abs(pressure - mp) > mp * CAST(0.10 AS DOUBLE) THEN 1 ELSE 0 END AS a,
            CASE WHEN t0 IS NULL OR {_gap('second', 86400)} THEN 1 ELSE 0 END AS g""",
        "g = 1 OR a = 0",
        """min(event_time) AS inicio, max(event_time) AS fim,
           date_diff('second', min(event_time), max(event_time)) AS duracao,
           CAST(sum(off_t) AS BIGINT) AS qtd_temp_irreg,
           CAST(sum(off_p) AS BIGINT) AS qtd_press_irreg""",
        "date_diff('second', min(event_time), max(event_time)) >= 120",
        "WHERE a = 1",
    )
    q["sensor_drift"] = _islands(
        f"{_mean('reading', 5, _ENTITY)} AS m",
        f"""CASE WHEN abs({x} - m) > m * CAST(0.12 AS DOUBLE) THEN 1 ELSE 0 END AS a,
            CASE WHEN t0 IS NULL OR {_gap('second', 86400)} THEN 1 ELSE 0 END AS g""",
        "NOT (a = 1 AND g = 0)",
        """min(event_time) AS inicio, max(event_time) AS fim,
           date_diff('second', min(event_time), max(event_time)) AS duracao,
           count(*) AS qtd_leituras""",
        "date_diff('second', min(event_time), max(event_time)) >= 180",
        "WHERE a = 1",
    )
    q["energy_anomaly"] = _islands(
        f"{_mean('reading', 6, _ENTITY)} AS m",
        f"""CASE WHEN {x} > m * CAST(1.25 AS DOUBLE) THEN 1 ELSE 0 END AS a,
            CASE WHEN t0 IS NULL OR {_gap('minute', 1440)} THEN 1 ELSE 0 END AS g""",
        "g = 1 OR a = 0",
        """min(event_time) AS inicio, max(event_time) AS fim,
           date_diff('minute', min(event_time), max(event_time)) AS duracao,
           count(*) AS qtd_leituras""",
        "date_diff('minute', min(event_time), max(event_time)) >= 10",
        "WHERE a = 1",
    )
    bad = """CASE WHEN processing_time_ms > 2000 OR coalesce(error_count, 0) > 0
                  THEN 1 ELSE 0 END AS a"""
    q["job_degraded"] = _islands(
        "1 AS one",
        f"{bad}, CASE WHEN {_gap('minute', 1440)} THEN 1 ELSE 0 END AS g",
        "a = 1 AND (t0 IS NULL OR a0 = 0 OR g = 1)",
        """min(event_time) AS inicio_periodo, max(event_time) AS fim_periodo,
           date_diff('minute', min(event_time), max(event_time)) AS duracao_minutos,
           CAST(max(processing_time_ms) AS DOUBLE) AS pior_processing_time,
           CAST(sum(coalesce(error_count, 0)) AS BIGINT) AS total_erros""",
        "date_diff('minute', min(event_time), max(event_time)) >= 10",
        "WHERE a = 1",
    )
    q["job_span"] = _query(
        ["readings"],
        """SELECT entity_id, min(event_time) AS inicio_periodo, max(event_time) AS fim_periodo,
               date_diff('minute', min(event_time), max(event_time)) AS duracao_minutos,
               CAST(max(processing_time_ms) AS DOUBLE) AS pior_processing_time,
               count(error_count) AS qtd_erros
           FROM readings GROUP BY entity_id
           HAVING date_diff('minute', min(event_time), max(event_time)) >= 10""",
    )
    q["job_degraded_loose"] = _islands(
        "1 AS one",
        f"{bad}, CASE WHEN {_gap('minute', 1440)} THEN 1 ELSE 0 END AS g",
        "a = 1 AND (t0 IS NULL OR g = 1)",
        """min(event_time) AS inicio_periodo, max(event_time) AS fim_periodo,
           date_diff('minute', min(event_time), max(event_time)) AS duracao_minutos,
           CAST(sum(error_count) AS BIGINT) AS total_erros,
           CAST(max(processing_time_ms) AS DOUBLE) AS pior_ms""",
        "date_diff('minute', min(event_time), max(event_time)) >= 10",
        "",
    )
    day = "PARTITION BY seller_id ORDER BY sale_date"
    q["seller_decline"] = _query(
        ["seller_daily"],
        f"""WITH_MORE looked AS (
            SELECT *, {_mean('total_orders', 7, day)} AS mo, {_mean('total_revenue', 7, day)} AS mr,
                   lag(sale_date) OVER ({day}) AS d0 FROM seller_daily),
        flagged AS (SELECT *, CASE WHEN total_orders < mo * CAST(0.6 AS DOUBLE)
                OR CAST(total_revenue AS DOUBLE) < mr * CAST(0.5 AS DOUBLE)
                THEN 1 ELSE 0 END AS a FROM looked),
        compared AS (SELECT *, lag(a) OVER ({day}) AS a0 FROM flagged),
        numbered AS (SELECT *, CAST(sum(CASE WHEN a = 1 AND (d0 IS NULL OR a0 = 0
                OR date_diff('day', d0, sale_date) <> 1) THEN 1 ELSE 0 END)
                OVER ({day} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grupo_id FROM compared)
        SELECT seller_id, grupo_id, min(sale_date) AS inicio_queda, max(sale_date) AS fim_queda,
               count(*) AS duracao_dias, min(total_orders) AS pior_dia_orders,
               CAST(min(total_revenue) AS DOUBLE) AS pior_dia_revenue,
               round(avg(mo), 6) AS media_orders_baseline,
               round(avg(mr), 4) AS media_revenue_baseline
        FROM numbered WHERE a = 1 GROUP BY seller_id, grupo_id HAVING count(*) >= 3""",
    )

    # -- deliveries
    q["warehouse_billing_delay"] = _delays(
        "fulfilment", "hub_id", "payment_at", "order_id",
        "date_diff('minute', payment_at, invoice_at)", 120, 120, "",
        """hub_id, CAST(island AS BIGINT) AS ilha_periodo, min(payment_at) AS inicio_periodo,
           max(payment_at) AS fim_periodo,
           date_diff('minute', min(payment_at), max(payment_at)) AS duracao_minutos,
           count(*) AS qnt_pedidos, max(d) AS pior_atraso""",
        "date_diff('minute', min(payment_at), max(payment_at)) >= 60 AND count(*) >= 3",
        known_only=True,
    )
    q["hub_prep_delay"] = _delays(
        "fulfilment", "hub_id", "payment_at", "order_id",
        "date_diff('minute', payment_at, packed_at)", 90, 120, "",
        """hub_id, CAST(island AS BIGINT) AS inicio_ilha, min(payment_at) AS inicio_periodo,
           max(payment_at) AS fim_periodo,
           date_diff('minute', min(payment_at), max(payment_at)) AS duracao_periodo_minutos,
           count(*) AS qtd_pedidos, count(*) FILTER (WHERE priority_flag = 1) AS qtd_prioritarios,
           max(d) AS pior_preparacao""",
        "date_diff('minute', min(payment_at), max(payment_at)) >= 45 AND count(*) >= 2",
    )
    q["driver_sla_streak"] = _delays(
        "deliveries", "driver_id", "pickup_ready_at", "delivery_id",
        "date_diff('minute', pickup_ready_at, delivered_at)", 35, 1440, "city,",
        """driver_id, city, min(pickup_ready_at) AS inicio_periodo,
           max(pickup_ready_at) AS fim_periodo, count(*) AS qnt_entregas, max(d) AS pior_sla,
           CAST(sum(d) AS BIGINT) AS aumento_total_sla""",
        "count(*) >= 3 AND sum(d) > 15",
    )
    driver = "PARTITION BY driver_id ORDER BY pickup_ready_at, delivery_id"
    q["delivery_sla_panel"] = _query(
        ["deliveries"],
        f"""WITH_MORE t AS (
            SELECT *, date_diff('minute', pickup_ready_at, out_for_delivery_at) AS wait,
                   date_diff('minute', out_for_delivery_at, delivered_at) AS route,
                   date_diff('minute', pickup_ready_at, delivered_at) AS sla FROM deliveries)
        SELECT delivery_id, driver_id AS delivery_person_id, centre_id AS distribution_center_id,
               pickup_ready_at, out_for_delivery_at, delivered_at, wait AS tempo_espera_cd,
               route AS tempo_rota, sla AS sla_total_min,
               CAST(hour(pickup_ready_at) AS INT) AS hora_pickup,
               CAST(dayofweek(pickup_ready_at) + 1 AS INT) AS dia_semana,
               CASE WHEN sla > 60 THEN 1 ELSE 0 END AS flag_sla_violation,
               CASE WHEN wait > 30 THEN 1 ELSE 0 END AS "flag_retenção_cd",
               round({_mean('sla', 7, driver)}, 6) AS media_movel_atraso_7,
               row_number() OVER ({driver}) AS ordem_entrega_motorista,
               count(*) FILTER (WHERE sla > 60) OVER (PARTITION BY driver_id)
                   AS total_atrasos_motorista,
               max(sla) OVER (PARTITION BY driver_id) AS pior_atraso_motorista,
               dense_rank() OVER (PARTITION BY driver_id ORDER BY sla DESC)
                   AS ranking_pior_entrega_motorista,
               count(*) FILTER (WHERE sla > 60) OVER (PARTITION BY centre_id) AS total_atrasos_cd,
               max(sla) OVER (PARTITION BY centre_id) AS pior_atraso_cd
        FROM t""",
    )
    q["driver_slowing"] = _query(
        ["deliveries"],
        """WITH_MORE t AS (
            SELECT driver_id, c_name AS driver_name, delivery_id, pickup_ready_at,
                   out_for_delivery_at, delivered_at,
                   date_diff('minute', out_for_delivery_at, delivered_at) AS sla_total_min
            FROM customer JOIN deliveries ON c_custkey = driver_id),
        looked AS (SELECT *, lag(sla_total_min) OVER w AS sla_total1,
                          lag(sla_total_min, 2) OVER w AS sla_total2 FROM t
                   WINDOW w AS (PARTITION BY driver_id ORDER BY delivered_at, delivery_id))
        SELECT * FROM looked WHERE sla_total_min > sla_total1 AND sla_total1 > sla_total2""",
    )

    # -- orders
    q["order_deceleration"] = _order_steps(
        """, marked AS (SELECT *, CASE WHEN gap < gap1 THEN 1 ELSE 0 END AS faster,
                               CASE WHEN gap > gap1 THEN 1 ELSE 0 END AS slower FROM compared),
        known AS (SELECT *, max(faster) OVER (@W ROWS BETWEEN UNBOUNDED PRECEDING
                                AND 1 PRECEDING) AS earlier FROM marked)
        SELECT customer_id, order_id, order_date, CAST(total_due AS DOUBLE) AS total_due,
               online_flag, before AS pedido_anterior, gap AS diff_dias_pedidos,
               faster AS flag_aceleracao, slower AS flag_desaceleracao,
               earlier AS teve_aceleracao_antes
        FROM known WHERE slower = 1 AND earlier = 1 AND online_flag = 1"""
    )
    q["order_acceleration_panel"] = _order_steps(
        """, marked AS (SELECT *, CASE WHEN gap < gap1 AND gap1 < gap2 THEN 1 ELSE 0 END AS faster
                        FROM compared),
        known AS (SELECT *, max(faster) OVER (@W ROWS BETWEEN UNBOUNDED PRECEDING
                                AND 1 PRECEDING) AS earlier FROM marked),
        slowed AS (SELECT *, CASE WHEN earlier = 1 AND gap > gap1 THEN 1 ELSE 0 END AS slower
                   FROM known)
        SELECT order_id, customer_id, customer_name, order_date, gap AS intervalo_dias,
               faster AS aceleracao, slower AS flag_desaceleracao,
               CAST(CASE WHEN earlier = 1 AND online_flag = 1 THEN sum(slower) OVER (
                    @W ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE 0 END AS BIGINT)
                   AS periodo_valido
        FROM slowed"""
    )

    # -- brands
    q["brand_metrics"] = _query(["brand_lines"], f"{_BRANDS} SELECT {_BRAND_COLUMNS} FROM metrics")
    q["brand_checks_total"] = _query(
        ["brand_lines"],
        f"""{_BRANDS} SELECT m.*, w.total_mes_cliente_calc,
                CAST(soma_marcas - w.total_mes_cliente_calc AS DOUBLE) AS diff
            FROM (SELECT id_cliente, ano, mes, CAST(sum(spend) AS DOUBLE) AS soma_marcas
                  FROM metrics GROUP BY ALL) m
            JOIN (SELECT id_cliente AS k, CAST(year(order_date) AS INT) AS y,
                         CAST(month(order_date) AS INT) AS n,
                         CAST(sum(valor_item) AS DOUBLE) AS total_mes_cliente_calc
                  FROM brand_lines GROUP BY ALL) w
              ON id_cliente = k AND ano = y AND mes = n""",
    )
    q["brand_checks_ticket"] = _query(
        ["brand_lines"],
        f"""{_BRANDS} SELECT id_cliente, marca, ano, mes, ticket_med_marca,
                round(total_mes_marca / freq_marca, 6) AS ticket_calc,
                CASE WHEN abs(ticket - total_mes_marca / freq_marca) <= 1e-9 THEN 'OK'
                     ELSE 'Erro' END AS valida_ticket FROM metrics""",
    )
    q["brand_checks_flags"] = _query(
        ["brand_lines"],
        f"""{_BRANDS} SELECT {_BRAND_COLUMNS} FROM metrics
            WHERE (contagem_3meses < 3 AND taxa_recompra_flag = 1)
               OR (total_mes_marca <= m3 * CAST(1.5 AS DOUBLE) AND flag_explosao = 1)""",
    )
    q["metrics_rollup"] = """
        SELECT o_orderpriority, o_orderstatus,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS soma_medida,
               round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
                     / count(o_totalprice), 6) AS media_medida,
               count(*) AS qtd
        FROM orders GROUP BY ALL"""
    # The same results from summaries of slices that merge.
    for name in ("terminal_instability", "energy_anomaly"):
        q[f"{name}_spread"] = q[name]
    return q
