"""DuckDB twins of ``vendora.sources.bindings`` as named CTEs.

``with_views(body)`` prefixes a SQL body with the CTEs it names (plus their
dependencies, in dependency order).  The strings are plain ANSI SQL over the
driver's pre-registered tables.
"""

from __future__ import annotations

import re

SHIFT = "INTERVAL 252 MONTH"


def _d(col: str) -> str:
    return f"CAST(CAST({col} AS DATE) + {SHIFT} AS DATE)"


VIEWS: dict[str, tuple[list[str], str]] = {
    "fx_orders": ([], f"""
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               {_d('o_orderdate')} AS order_date,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                                  WHEN 'P' THEN 'cancelled' END AS order_status,
               o_orderpriority AS payment_method,
               o_totalprice AS order_total
        FROM orders"""),
    "fx_orders_zip": (["fx_orders"], """
        SELECT f.*, c.c_nationkey AS zip
        FROM fx_orders f JOIN customer c ON f.customer_id = c.c_custkey"""),
    "fx_order_items": ([], """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_number,
               CAST(l_quantity AS INTEGER) AS quantity,
               l_extendedprice / l_quantity AS unit_price,
               CASE WHEN l_discount > 0.06
                    THEN 'PROMO' || CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) END AS promo_id,
               CASE WHEN l_discount > 0.08 AND l_tax > 0.04
                    THEN 'STACK' || CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) END AS promo_id_2,
               l_discount AS discount, l_extendedprice AS extended_price
        FROM lineitem"""),
    "fx_product_dims": ([], """
        SELECT p_partkey AS product_id, p_retailprice AS cogs, p_brand AS segment,
               p_type AS category,
               CASE CAST(floor((p_size - 1) / 13) AS INTEGER)
                    WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' WHEN 3 THEN 'XL' END AS size
        FROM part"""),
    "fx_products": (["fx_product_dims"], """
        SELECT d.*, pr.price
        FROM fx_product_dims d
        LEFT JOIN (SELECT l_partkey AS product_id, avg(l_extendedprice / l_quantity) AS price
                   FROM lineitem GROUP BY l_partkey) pr USING (product_id)"""),
    "fx_returns": ([], f"""
        SELECT l_orderkey AS order_id, l_partkey AS product_id,
               'R' || CAST(l_linenumber AS VARCHAR) AS return_reason,
               CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                 AS refund_amount,
               {_d('l_shipdate')} AS return_date
        FROM lineitem WHERE l_returnflag = 'R'"""),
    "fx_customers": ([], """
        SELECT c_custkey AS customer_id,
               CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE c_mktsegment END AS age_group,
               c_mktsegment AS acquisition_channel, c_nationkey AS zip
        FROM customer"""),
    "fx_geography": ([], """
        SELECT n.n_nationkey AS zip, r.r_name AS region
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "fx_payments": ([], """
        SELECT o_orderkey AS order_id,
               CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 12 END
                 AS installments,
               o_totalprice AS payment_value
        FROM orders"""),
    "fx_web_traffic": ([], """
        SELECT CAST(ts AS DATE) AS date, event_type AS traffic_source,
               value / 100 AS bounce_rate, user_id
        FROM events"""),
    "fx_sales_lines": (["fx_geography"], f"""
        SELECT {_d('o.o_orderdate')} AS date,
               CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
                 AS line_revenue,
               CAST(l.l_quantity AS DECIMAL(18,2)) * CAST(p.p_retailprice AS DECIMAL(18,2)) AS line_cogs,
               g.region || '|' || p.p_type AS series_id
        FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN part p ON l.l_partkey = p.p_partkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN fx_geography g ON c.c_nationkey = g.zip"""),
    "fx_sales": (["fx_sales_lines"], """
        SELECT date, CAST(round(sum(line_revenue), 2) AS DOUBLE) AS revenue,
               CAST(round(sum(line_cogs), 2) AS DOUBLE) AS cogs
        FROM fx_sales_lines GROUP BY date"""),
    "fx_sales_panel": (["fx_sales_lines"], """
        SELECT series_id, date, CAST(round(sum(line_revenue), 2) AS DOUBLE) AS revenue,
               CAST(round(sum(line_cogs), 2) AS DOUBLE) AS cogs
        FROM fx_sales_lines GROUP BY series_id, date"""),
    "fx_shipments": (["fx_orders_zip"], f"""
        SELECT o.order_id, l.l_linenumber AS line_number, o.zip, o.order_date,
               {_d('l.l_shipdate')} AS ship_date,
               date_diff('day', o.order_date, {_d('l.l_shipdate')}) AS lead_days
        FROM lineitem l JOIN fx_orders_zip o ON l.l_orderkey = o.order_id"""),
    "fx_inv_daily": ([], f"""
        SELECT p.p_brand AS brand, {_d('o.o_orderdate')} AS day,
               date_trunc('month', {_d('o.o_orderdate')})::DATE AS month,
               sum(l.l_quantity) AS units
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN part p ON l.l_partkey = p.p_partkey
        GROUP BY 1, 2, 3"""),
    "fx_inv_items": ([], f"""
        SELECT l.l_partkey AS product_id, {_d('o.o_orderdate')} AS day,
               date_trunc('month', {_d('o.o_orderdate')})::DATE AS month, sum(l.l_quantity) AS units
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN part p ON l.l_partkey = p.p_partkey
        GROUP BY 1, 2, 3"""),
    "fx_inventory": (["fx_inv_daily"], """
        SELECT m.brand, m.month, r.received, m.sold,
               least(1.0, m.sold / r.received) AS sell_through,
               CAST(m.sold >= r.received AS INTEGER) AS stockout_flag,
               coalesce(date_diff('day', s.stockout_start, last_day(m.month)), 0) AS stockout_days,
               least(m.sold, r.received) AS filled
        FROM (SELECT brand, month, sum(units) AS sold FROM fx_inv_daily GROUP BY 1, 2) m
        JOIN (SELECT brand, avg(sold) AS received
              FROM (SELECT brand, month, sum(units) AS sold FROM fx_inv_daily GROUP BY 1, 2)
              GROUP BY brand) r USING (brand)
        LEFT JOIN (
          SELECT brand, month, min(day) AS stockout_start FROM (
            SELECT d.*, r2.received,
                   sum(d.units) OVER (PARTITION BY d.brand, d.month ORDER BY d.day
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
            FROM fx_inv_daily d
            JOIN (SELECT brand, avg(sold) AS received
                  FROM (SELECT brand, month, sum(units) AS sold FROM fx_inv_daily GROUP BY 1, 2)
                  GROUP BY brand) r2 USING (brand)) t
          WHERE running >= received GROUP BY brand, month) s USING (brand, month)"""),
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str):
        if n in out:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the fx_* views it mentions and any extra CTEs.

    ``extra_ctes`` are (name, sql) pairs that may themselves use fx_* views;
    they are emitted after the views, in the given order.
    """
    text = body + " ".join(sql for _, sql in (extra_ctes or []))
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", text)]
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _closure(used)]
    parts += [f"{n} AS ({sql})" for n, sql in (extra_ctes or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
