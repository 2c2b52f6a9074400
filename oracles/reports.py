"""Expected results of the analytical reports, written for DuckDB."""

from __future__ import annotations

from oracles.roles import CORE, MATCHED, avg2, big, days2, money, pct, rnd, with_roles


def _activity(label: str, where: str) -> str:
    return f"""
    SELECT {label},
      count(*) AS recorded_orders,
      count(*) FILTER (order_status = 'delivered') AS completed_orders,
      {pct("count(*) FILTER (order_status = 'delivered')", "count(*)")}
        AS completed_order_rate_pct,
      count(DISTINCT person) AS recorded_unique_customers,
      count(DISTINCT person) FILTER (order_status = 'delivered') AS completed_unique_customers,
      {big("sum(n)")} AS recorded_items,
      {big("coalesce(sum(n) FILTER (order_status = 'delivered'), 0)")} AS completed_items,
      {money("coalesce(sum(sales) FILTER (order_status = 'delivered'), 0)")}
        AS completed_item_sales_value,
      {avg2("coalesce(sum(sales) FILTER (order_status = 'delivered'), 0)",
            "count(*) FILTER (order_status = 'delivered')")}
        AS avg_item_sales_value_per_completed_order
    FROM m_orders LEFT JOIN m_baskets USING (order_id) LEFT JOIN m_customers USING (customer_id)
    WHERE {where} GROUP BY ALL HAVING sum(n) > 0"""


_YEAR = "CAST(year(bought) AS INTEGER) AS order_year"

def _lag(expr: str) -> str:
    before = f"(lag({expr}) OVER w)::DOUBLE"
    return rnd(f"100.0::DOUBLE * (({expr})::DOUBLE - {before}) / nullif({before}, 0)")


def _concentration(source: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""
    SELECT *, row_number() OVER (w) AS place, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS running,
           sum(v) OVER ({part}) AS whole
    FROM {source} WINDOW w AS ({part} ORDER BY v DESC, id)"""


_REVIEW_COLUMNS = f"""
  {pct("count(r.order_id)", "count(*)")} AS review_coverage_pct,
  {avg2("sum(score)", "count(score)")} AS avg_review_score,
  {pct("count(*) FILTER (score <= 2)", "count(r.order_id)")} AS low_review_rate_pct,
  {pct("count(*) FILTER (score >= 4)", "count(r.order_id)")} AS high_review_rate_pct"""

_DURATIONS = f"""
  count(*) AS eligible_delivered_orders,
  {days2("sum(took)", "count(*)")} AS avg_delivery_days,
  {days2("sum(promised)", "count(*)")} AS avg_estimated_delivery_days,
  count(*) FILTER (arrived > due) AS late_orders,
  {pct("count(*) FILTER (arrived > due)", "count(*)")} AS late_delivery_rate_pct,
  {days2("sum(slip) FILTER (arrived > due)", "count(*) FILTER (arrived > due)")}
    AS avg_delay_days_for_late_orders"""
_EARLY = f"""
  {days2("sum(-slip) FILTER (arrived <= due)", "count(*) FILTER (arrived <= due)")}
    AS avg_days_early_for_on_time_orders"""

_CARD = f"""
  {pct("count(*)", "sum(count(*)) OVER ()")} AS payment_record_share_pct,
  {money("sum(paid)")} AS recorded_credit_card_value,
  {avg2("sum(paid)", "count(*)")} AS avg_credit_card_payment_value
FROM m_payments WHERE method = 'credit_card' GROUP BY ALL"""

_PERSON_VALUE = """
  SELECT person, count(*) AS orders, sum(n) AS items, sum(sales) AS sales
  FROM m_done JOIN m_baskets USING (order_id) JOIN m_customers USING (customer_id)
  GROUP BY ALL"""

_SQL = {
    "marketplace_scale": f"""
    WITH o AS (SELECT count(*) AS n, count(*) FILTER (order_status = 'delivered') AS d,
                      count(DISTINCT person) AS p,
                      count(DISTINCT person) FILTER (order_status = 'delivered') AS pd
               FROM m_orders LEFT JOIN m_customers USING (customer_id)),
    i AS (SELECT count(*) AS n, count(*) FILTER (order_status = 'delivered') AS d,
             count(DISTINCT product_id) AS p,
             count(DISTINCT product_id) FILTER (order_status = 'delivered') AS pd,
             count(DISTINCT seller_id) AS s,
             count(DISTINCT seller_id) FILTER (order_status = 'delivered') AS sd,
             sum(price) AS v, sum(price) FILTER (order_status = 'delivered') AS vd,
             sum(freight_raw) AS f, sum(freight_raw) FILTER (order_status = 'delivered') AS fd
          FROM m_items JOIN m_orders USING (order_id))
    SELECT o.n AS recorded_orders, o.d AS completed_orders,
      {pct("o.d", "o.n")} AS completed_order_rate_pct,
      o.p AS recorded_unique_customers, o.pd AS completed_unique_customers,
      i.n AS recorded_items, i.d AS completed_items, i.p AS recorded_products,
      i.pd AS completed_products, i.s AS recorded_sellers, i.sd AS completed_sellers,
      {money("v")} AS recorded_item_sales_value, {money("vd")} AS completed_item_sales_value,
      {money("f")} AS recorded_freight_value, {money("fd")} AS completed_freight_value,
      {avg2("i.d", "o.d")} AS avg_items_per_completed_order,
      {avg2("vd", "o.d")} AS avg_item_sales_value_per_completed_order
    FROM o, i""",
    "monthly_trends": _activity("strftime(bought, '%Y-%m') AS order_month", CORE),
    "matched_period_metrics": _activity(_YEAR, MATCHED),
    "matched_period_growth": f"""
    WITH y AS (SELECT {_YEAR}, count(*) FILTER (order_status = 'delivered') AS o,
                 count(DISTINCT person) FILTER (order_status = 'delivered') AS p,
                 sum(n) FILTER (order_status = 'delivered') AS i,
                 sum(sales) FILTER (order_status = 'delivered') AS v
               FROM m_orders LEFT JOIN m_baskets USING (order_id)
               LEFT JOIN m_customers USING (customer_id)
               WHERE {MATCHED} GROUP BY ALL)
    SELECT order_year, {_lag("o")} AS completed_order_growth_pct,
      {_lag("p")} AS completed_customer_growth_pct, {_lag("i")} AS completed_item_growth_pct,
      {_lag("v")} AS completed_item_sales_value_growth_pct,
      {_lag("v::DOUBLE / o")} AS avg_item_sales_value_per_order_growth_pct
    FROM y WINDOW w AS (ORDER BY order_year) QUALIFY lag(o) OVER w IS NOT NULL""",
    "status_mix": f"""
    WITH g AS (SELECT {_YEAR}, order_status, count(*) AS k
               FROM m_orders WHERE {MATCHED} GROUP BY ALL)
    SELECT order_year, order_status, k AS order_count,
      {pct("k", "sum(k) OVER (PARTITION BY order_year)")} AS status_share_pct FROM g""",
    "merchandise_by_status": f"""
    SELECT order_status, count(*) AS recorded_orders, count(n) AS orders_with_items,
      {big("coalesce(sum(n), 0)")} AS item_count,
      {money("coalesce(sum(sales), 0)")} AS item_sales_value,
      {pct("coalesce(sum(sales), 0)", "sum(coalesce(sum(sales), 0)) OVER ()")}
        AS item_sales_value_share_pct,
      {money("coalesce(sum(freight), 0)")} AS freight_value
    FROM m_orders LEFT JOIN m_baskets USING (order_id) GROUP BY ALL""",
    "marketplace_concentration": f"""
    WITH e AS (
      SELECT 'customer' AS kind, CAST(person AS VARCHAR) AS id, sales AS v
        FROM ({_PERSON_VALUE})
      UNION ALL SELECT 'category', coalesce(source, 'unknown'), sum(price)
        FROM m_done_items JOIN m_products USING (product_id) GROUP BY ALL
      UNION ALL SELECT 'seller', CAST(seller_id AS VARCHAR), sum(price)
        FROM m_done_items GROUP BY ALL),
    r AS ({_concentration("e", "kind")}),
    g AS (SELECT kind, count(*) AS total,
            min(place) FILTER (running * 2 >= whole) AS half,
            min(place) FILTER (running * 10 >= whole * 8) AS most
          FROM r GROUP BY kind)
    SELECT kind AS entity_type, total AS total_entities, half AS entities_for_50_pct,
      {pct("half", "total")} AS entity_share_for_50_pct, most AS entities_for_80_pct,
      {pct("most", "total")} AS entity_share_for_80_pct FROM g""",
    "customer_base_repeat": f"""
    WITH p AS (SELECT person, count(DISTINCT order_id) AS r,
                 count(DISTINCT order_id) FILTER (order_status = 'delivered') AS d
               FROM m_customers JOIN m_orders USING (customer_id) GROUP BY ALL)
    SELECT count(*) AS recorded_unique_customers,
      count(*) FILTER (r > 1) AS recorded_repeat_customers,
      {pct("count(*) FILTER (r > 1)", "count(*)")} AS recorded_repeat_customer_rate_pct,
      count(*) FILTER (d > 0) AS completed_unique_customers,
      count(*) FILTER (d > 1) AS completed_repeat_customers,
      {pct("count(*) FILTER (d > 1)", "count(*) FILTER (d > 0)")}
        AS completed_repeat_customer_rate_pct,
      {big("sum(d)")} AS completed_orders,
      {big("sum(d) FILTER (d > 1)")} AS completed_orders_from_repeat_customers,
      {pct("sum(d) FILTER (d > 1)", "sum(d)")}
        AS completed_order_share_from_repeat_customers_pct,
      {avg2("sum(d)", "count(*) FILTER (d > 0)")} AS avg_completed_orders_per_customer,
      {avg2("sum(d) FILTER (d > 1)", "count(*) FILTER (d > 1)")}
        AS avg_completed_orders_per_repeat_customer
    FROM p""",
    "customer_order_frequency": f"""
    WITH p AS (SELECT person, count(DISTINCT order_id) AS d
               FROM m_customers JOIN m_done USING (customer_id) GROUP BY ALL),
    f AS (SELECT d, count(*) AS n FROM p GROUP BY d)
    SELECT d AS completed_orders, n AS customer_count,
      {pct("n", "sum(n) OVER ()")} AS customer_share_pct,
      {pct("sum(n) OVER (ORDER BY d)", "sum(n) OVER ()")} AS cumulative_customer_share_pct
    FROM f""",
    "customer_one_time_vs_repeat": f"""
    WITH p AS ({_PERSON_VALUE}),
    s AS (SELECT if(orders > 1, 'repeat', 'one_time') AS customer_type, count(*) AS c,
            sum(orders) AS o, sum(items) AS i, sum(sales) AS v FROM p GROUP BY ALL)
    SELECT customer_type, c AS customer_count, {pct("c", "sum(c) OVER ()")} AS customer_share_pct,
      {big("o")} AS completed_orders, {pct("o", "sum(o) OVER ()")} AS completed_order_share_pct,
      {big("i")} AS completed_items, {money("v")} AS completed_item_sales_value,
      {pct("v", "sum(v) OVER ()")} AS item_sales_value_share_pct,
      {avg2("o", "c")} AS avg_completed_orders_per_customer,
      {avg2("i", "c")} AS avg_items_per_customer,
      {avg2("v", "c")} AS avg_item_sales_value_per_customer,
      {avg2("v", "o")} AS avg_item_sales_value_per_completed_order
    FROM s""",
    "customer_value_deciles": f"""
    WITH p AS ({_PERSON_VALUE}),
    d AS (SELECT sales, ntile(10) OVER (ORDER BY sales, person) AS t FROM p)
    SELECT CAST(t AS INTEGER) AS value_decile, count(*) AS customer_count,
      {money("min(sales)")} AS min_customer_item_sales_value,
      {avg2("sum(sales)", "count(*)")} AS avg_customer_item_sales_value,
      {money("max(sales)")} AS max_customer_item_sales_value,
      {money("sum(sales)")} AS total_item_sales_value,
      {pct("sum(sales)", "sum(sum(sales)) OVER ()")} AS item_sales_value_share_pct
    FROM d GROUP BY t""",
    "customer_geography": f"""
    WITH h AS (SELECT person, count(*) AS k FROM m_done JOIN m_customers USING (customer_id)
               GROUP BY ALL),
    s AS (SELECT state, count(DISTINCT person) AS p,
            count(DISTINCT person) FILTER (k > 1) AS r, count(DISTINCT order_id) AS o,
            sum(n) AS i, sum(sales) AS v
          FROM m_done JOIN m_baskets USING (order_id) JOIN m_customers USING (customer_id)
          JOIN h USING (person) GROUP BY ALL)
    SELECT state AS customer_state, p AS completed_unique_customers,
      r AS completed_repeat_customers, {pct("r", "p")} AS repeat_customer_rate_pct,
      o AS completed_orders, {pct("o", "sum(o) OVER ()")} AS completed_order_share_pct,
      {big("i")} AS completed_items, {money("v")} AS completed_item_sales_value,
      {pct("v", "sum(v) OVER ()")} AS item_sales_value_share_pct,
      {avg2("v", "o")} AS avg_item_sales_value_per_completed_order FROM s""",
    "delivery_population": f"""
    SELECT count(*) AS delivered_orders, count(arrived) AS orders_with_customer_delivery_date,
      count(*) - count(arrived) AS orders_missing_customer_delivery_date,
      count(due) AS orders_with_estimated_delivery_date,
      count(arrived + (due - due)) AS orders_eligible_for_lateness_analysis,
      {pct("count(arrived + (due - due))", "count(*)")} AS lateness_analysis_coverage_pct
    FROM m_done""",
    "delivery_chronology": """
    SELECT count(*) FILTER (arrived < bought) AS delivery_before_purchase,
      count(*) FILTER (arrived < carried) AS customer_delivery_before_carrier,
      count(*) FILTER (due < bought) AS estimate_before_purchase FROM m_done""",
    "delivery_reliability": f"""
    SELECT {_DURATIONS}, count(*) FILTER (arrived <= due) AS on_time_or_early_orders, {_EARLY}
    FROM m_eligible""",
    "delivery_percentiles": f"""
    WITH d AS (SELECT quantile_cont(took, 0.5) AS m,
                 quantile_disc(took, [0.75, 0.9, 0.95]) AS q, max(took) AS x FROM m_eligible),
    l AS (SELECT quantile_cont(slip, 0.5) AS m, quantile_disc(slip, [0.9, 0.95]) AS q,
            max(slip) AS x FROM m_eligible WHERE slip > 0)
    SELECT {rnd("d.m / 86400")} AS median_delivery_days,
      {rnd("d.q[1] / 86400")} AS p75_delivery_days,
      {rnd("d.q[2] / 86400")} AS p90_delivery_days,
      {rnd("d.q[3] / 86400")} AS p95_delivery_days,
      {rnd("d.x / 86400")} AS max_delivery_days,
      {rnd("l.m / 86400")} AS median_late_delay_days,
      {rnd("l.q[1] / 86400")} AS p90_late_delay_days,
      {rnd("l.q[2] / 86400")} AS p95_late_delay_days,
      {rnd("l.x / 86400")} AS max_late_delay_days
    FROM d, l""",
    "delivery_by_month": f"""
    SELECT strftime(bought, '%Y-%m') AS order_month, {_DURATIONS}, {_EARLY}
    FROM m_eligible WHERE {CORE} GROUP BY ALL""",
    "delivery_by_matched_year": f"""
    SELECT {_YEAR}, {_DURATIONS}, {_EARLY} FROM m_eligible WHERE {MATCHED} GROUP BY ALL""",
    "delivery_review_coverage": f"""
    WITH e AS (SELECT arrived > due AS late, r.order_id IS NOT NULL AS rev
               FROM m_eligible LEFT JOIN m_last_review r USING (order_id))
    SELECT count(*) AS eligible_delivered_orders, count(*) FILTER (rev) AS reviewed_eligible_orders,
      count(*) FILTER (NOT rev) AS orders_without_review,
      {pct("count(*) FILTER (rev)", "count(*)")} AS review_coverage_pct,
      count(*) FILTER (NOT late) AS on_time_or_early_orders,
      count(*) FILTER (NOT late AND rev) AS reviewed_on_time_or_early_orders,
      {pct("count(*) FILTER (NOT late AND rev)", "count(*) FILTER (NOT late)")}
        AS on_time_review_coverage_pct,
      count(*) FILTER (late) AS late_orders, count(*) FILTER (late AND rev) AS reviewed_late_orders,
      {pct("count(*) FILTER (late AND rev)", "count(*) FILTER (late)")}
        AS late_review_coverage_pct
    FROM e""",
    "delay_review_outcomes": f"""
    WITH b(lo, hi, name) AS (VALUES (-1e12, 0, 'on_time_or_early'), (0, 3, 'over_0_to_3_days_late'),
      (3, 7, 'over_3_to_7_days_late'), (7, 14, 'over_7_to_14_days_late'),
      (14, 30, 'over_14_to_30_days_late'), (30, 1e12, 'over_30_days_late'))
    SELECT name AS delay_group, count(*) AS eligible_orders,
      count(r.order_id) AS reviewed_orders, {_REVIEW_COLUMNS}
    FROM m_eligible e JOIN b ON slip > lo * 86400 AND slip <= hi * 86400
    LEFT JOIN m_last_review r ON r.order_id = e.order_id GROUP BY name""",
    "delivery_by_state": f"""
    WITH s AS (SELECT state, {_DURATIONS}, sum(took) AS t
               FROM m_eligible JOIN m_customers USING (customer_id) GROUP BY ALL),
    a AS (SELECT *, eligible_delivered_orders AS n, sum(eligible_delivered_orders) OVER () AS n_all,
            sum(late_orders) OVER () AS late_all, sum(t) OVER () AS t_all FROM s)
    SELECT state AS customer_state, n AS eligible_delivered_orders,
      {pct("n", "n_all")} AS eligible_order_share_pct, avg_delivery_days,
      avg_estimated_delivery_days, late_orders, late_delivery_rate_pct,
      {rnd("100.0::DOUBLE * late_orders / n - 100.0::DOUBLE * late_all::DOUBLE / n_all")}
        AS late_rate_vs_marketplace_pp,
      {rnd("(t::DOUBLE / n - t_all::DOUBLE / n_all) / 86400")} AS delivery_days_vs_marketplace,
      avg_delay_days_for_late_orders FROM a""",
    "category_population": f"""
    WITH x AS (SELECT * FROM m_done_items JOIN m_labels USING (product_id))
    SELECT count(*) AS completed_items, count(DISTINCT product_id) AS completed_products,
      {money("sum(price)")} AS completed_item_sales_value,
      count(*) FILTER (source IS NULL) AS items_missing_category,
      {pct("count(*) FILTER (source IS NULL)", "count(*)")} AS items_missing_category_pct,
      {money("sum(price) FILTER (source IS NULL)")} AS sales_value_missing_category,
      count(*) FILTER (source IS NOT NULL AND english IS NULL) AS items_with_untranslated_category,
      {money("sum(price) FILTER (source IS NOT NULL AND english IS NULL)")}
        AS sales_value_untranslated_category,
      count(DISTINCT source) AS represented_source_categories,
      count(DISTINCT english) AS represented_translated_categories FROM x""",
    "category_performance": f"""
    WITH g AS (SELECT source, label, count(DISTINCT order_id) AS o, count(*) AS i,
                 count(DISTINCT product_id) AS p, sum(price) AS v
               FROM m_done_items JOIN m_labels USING (product_id) GROUP BY ALL)
    SELECT label AS category_name, o AS completed_orders, i AS items_sold, p AS products_sold,
      {money("v")} AS item_sales_value, {pct("v", "sum(v) OVER ()")} AS item_sales_value_share_pct,
      {pct("i", "sum(i) OVER ()")} AS item_share_pct, {avg2("v", "i")} AS avg_item_price,
      {avg2("v", "o")} AS avg_category_sales_value_per_order FROM g""",
    "category_growth": f"""
    WITH g AS (SELECT source, label,
        count(DISTINCT order_id) FILTER (year(bought) = 1996) AS o1,
        count(DISTINCT order_id) FILTER (year(bought) = 1997) AS o2,
        count(*) FILTER (year(bought) = 1996) AS i1, count(*) FILTER (year(bought) = 1997) AS i2,
        coalesce(sum(price) FILTER (year(bought) = 1996), 0) AS v1,
        coalesce(sum(price) FILTER (year(bought) = 1997), 0) AS v2
      FROM m_done_items JOIN m_labels USING (product_id) WHERE {MATCHED} GROUP BY ALL),
    t AS (SELECT *, sum(v1) OVER () AS t1, sum(v2) OVER () AS t2 FROM g)
    SELECT label AS category_name, o1 AS completed_orders_1996, o2 AS completed_orders_1997,
      i1 AS items_sold_1996, i2 AS items_sold_1997, {money("v1")} AS item_sales_value_1996,
      {money("v2")} AS item_sales_value_1997, {money("v2 - v1")} AS item_sales_value_change,
      {pct("v2 - v1", "v1")} AS item_sales_value_growth_pct,
      {pct("v1", "t1")} AS marketplace_share_1996_pct,
      {pct("v2", "t2")} AS marketplace_share_1997_pct,
      {rnd("100.0::DOUBLE * v2::DOUBLE / t2::DOUBLE - 100.0::DOUBLE * v1::DOUBLE / t1::DOUBLE")}
        AS marketplace_share_change_pp,
      {pct("v2 - v1", "t2 - t1")} AS contribution_to_sales_growth_pct FROM t""",
    "product_concentration": f"""
    WITH e AS (SELECT product_id AS id, sum(price) AS v FROM m_done_items GROUP BY ALL),
    r AS ({_concentration("e", "")}),
    g AS (SELECT count(*) AS total, min(place) FILTER (running * 2 >= whole) AS half,
            min(place) FILTER (running * 10 >= whole * 8) AS most FROM r)
    SELECT total AS completed_products, half AS products_for_50_pct_sales,
      {pct("half", "total")} AS product_share_for_50_pct_sales, most AS products_for_80_pct_sales,
      {pct("most", "total")} AS product_share_for_80_pct_sales FROM g""",
    "top_products": f"""
    WITH g AS (SELECT product_id, label, count(DISTINCT order_id) AS o, count(*) AS i,
                 sum(price) AS v
               FROM m_done_items JOIN m_labels USING (product_id) GROUP BY ALL)
    SELECT CAST(row_number() OVER w AS INTEGER) AS product_rank, product_id,
      label AS category_name, o AS completed_orders, i AS items_sold,
      {money("v")} AS item_sales_value, {pct("v", "sum(v) OVER ()")} AS item_sales_value_share_pct,
      {avg2("v", "i")} AS avg_item_price
    FROM g WINDOW w AS (ORDER BY v DESC, product_id) QUALIFY row_number() OVER w <= 20""",
    "category_review_outcomes": f"""
    WITH x AS (SELECT DISTINCT order_id, source, label FROM m_items JOIN m_labels USING (product_id))
    SELECT label AS category_name, count(*) AS orders_with_category,
      count(r.order_id) AS reviewed_orders, {_REVIEW_COLUMNS}
    FROM x LEFT JOIN m_last_review r ON r.order_id = x.order_id GROUP BY source, label""",
    "seller_population": f"""
    WITH o AS (SELECT order_id, count(DISTINCT seller_id) AS s FROM m_done_items GROUP BY ALL),
    a AS (SELECT count(DISTINCT seller_id) AS s, count(DISTINCT product_id) AS p, count(*) AS i,
            sum(price) AS v FROM m_done_items)
    SELECT (SELECT count(*) FROM m_done) AS completed_orders,
      count(*) AS completed_orders_with_items,
      (SELECT count(*) FROM m_done) - count(*) AS completed_orders_without_items,
      any_value(a.s) AS active_sellers, any_value(a.p) AS products_sold,
      any_value(a.i) AS completed_items, {money("any_value(a.v)")} AS completed_item_sales_value,
      count(*) FILTER (o.s = 1) AS single_seller_orders,
      count(*) FILTER (o.s > 1) AS multi_seller_orders,
      {pct("count(*) FILTER (o.s > 1)", "count(*)")} AS multi_seller_order_pct,
      {avg2("sum(o.s)", "count(*)")} AS avg_sellers_per_order, max(o.s) AS max_sellers_per_order,
      {big("sum(o.s)")} AS seller_order_relationships FROM o, a""",
    "top_sellers": f"""
    WITH g AS (SELECT seller_id, count(DISTINCT order_id) AS o, count(*) AS i,
                 count(DISTINCT product_id) AS p, sum(price) AS v FROM m_done_items GROUP BY ALL)
    SELECT CAST(row_number() OVER w AS INTEGER) AS seller_rank, seller_id, o AS completed_orders,
      i AS items_sold, p AS products_sold, {money("v")} AS item_sales_value,
      {pct("v", "sum(v) OVER ()")} AS item_sales_value_share_pct, {avg2("v", "i")} AS avg_item_price,
      {avg2("v", "o")} AS avg_seller_sales_value_per_order
    FROM g WINDOW w AS (ORDER BY v DESC, seller_id) QUALIFY row_number() OVER w <= 20""",
    "seller_base_growth": f"""
    WITH g AS (SELECT {_YEAR}, seller_id, count(DISTINCT order_id) AS o, count(*) AS i,
                 sum(price) AS v FROM m_done_items WHERE {MATCHED} GROUP BY ALL)
    SELECT order_year, count(*) AS active_sellers, {big("sum(o)")} AS seller_order_relationships,
      {big("sum(i)")} AS completed_items, {money("sum(v)")} AS item_sales_value,
      {avg2("sum(o)", "count(*)")} AS avg_completed_orders_per_active_seller,
      {avg2("sum(v)", "count(*)")} AS avg_item_sales_value_per_active_seller
    FROM g GROUP BY ALL""",
    "seller_participation": f"""
    WITH g AS (SELECT seller_id, coalesce(sum(price) FILTER (year(bought) = 1996), 0) AS v1,
                 coalesce(sum(price) FILTER (year(bought) = 1997), 0) AS v2,
                 list_sort(list(DISTINCT year(bought))) AS ys
               FROM m_done_items WHERE {MATCHED} GROUP BY ALL)
    SELECT if(len(ys) = 2, 'active_in_both_periods', 'active_' || ys[1] || '_only')
        AS participation_group, count(*) AS sellers,
      {money("sum(v1)")} AS item_sales_value_1996, {money("sum(v2)")} AS item_sales_value_1997
    FROM g GROUP BY ALL""",
    "seller_geography": f"""
    WITH x AS (SELECT * FROM m_done_items JOIN m_sellers USING (seller_id)),
    g AS (SELECT state, count(DISTINCT seller_id) AS s, count(DISTINCT order_id) AS o,
            count(*) AS i, count(DISTINCT product_id) AS p, sum(price) AS v FROM x GROUP BY ALL),
    t AS (SELECT count(DISTINCT seller_id) AS ts, count(*) AS ti, sum(price) AS tv FROM x)
    SELECT state AS seller_state, s AS active_sellers, {pct("s", "ts")} AS active_seller_share_pct,
      o AS completed_orders_with_state_seller, i AS items_sold, {pct("i", "ti")} AS item_share_pct,
      p AS products_sold, {money("v")} AS item_sales_value,
      {pct("v", "tv")} AS item_sales_value_share_pct,
      {avg2("v", "s")} AS avg_item_sales_value_per_active_seller FROM g, t""",
    "payment_population": f"""
    WITH g AS (SELECT order_id, count(*) AS n, count(DISTINCT method) AS m, sum(paid) AS v
               FROM m_payments GROUP BY ALL)
    SELECT (SELECT count(*) FROM m_orders) AS recorded_orders, count(*) AS orders_with_payments,
      (SELECT count(*) FROM m_orders) - count(*) AS orders_without_payments,
      {big("sum(n)")} AS payment_records, {money("sum(v)")} AS recorded_payment_value,
      count(*) FILTER (n = 1) AS single_payment_record_orders,
      count(*) FILTER (n > 1) AS multiple_payment_record_orders,
      {pct("count(*) FILTER (n > 1)", "count(*)")} AS multiple_payment_record_order_pct,
      count(*) FILTER (m > 1) AS multiple_payment_method_orders,
      {pct("count(*) FILTER (m > 1)", "count(*)")} AS multiple_payment_method_order_pct,
      {avg2("sum(n)", "count(*)")} AS avg_payment_records_per_paid_order,
      max(n) AS max_payment_records_per_order, max(m) AS max_payment_methods_per_order FROM g""",
    "payment_method_mix": f"""
    WITH t AS (SELECT count(*) AS n, count(DISTINCT order_id) AS o, sum(paid) AS v FROM m_payments),
    g AS (SELECT method, count(*) AS n, count(DISTINCT order_id) AS o, sum(paid) AS v
          FROM m_payments GROUP BY ALL)
    SELECT method AS payment_type, g.n AS payment_records,
      {pct("g.n", "t.n")} AS payment_record_share_pct, g.o AS orders_using_method,
      {pct("g.o", "t.o")} AS paid_order_usage_pct, {money("g.v")} AS recorded_payment_value,
      {pct("g.v", "t.v")} AS payment_value_share_pct,
      {avg2("g.v", "g.n")} AS avg_payment_record_value FROM g, t""",
    "payment_method_combinations": f"""
    WITH g AS (SELECT order_id, string_agg(DISTINCT method, ' + ' ORDER BY method) AS mix,
                 sum(paid) AS v FROM m_payments GROUP BY ALL HAVING count(DISTINCT method) > 1)
    SELECT mix AS payment_method_combination, count(*) AS mixed_payment_orders,
      {pct("count(*)", "sum(count(*)) OVER ()")} AS mixed_order_share_pct,
      {avg2("sum(v)", "count(*)")} AS avg_order_payment_value FROM g GROUP BY mix""",
    "installment_distribution": f"""
    SELECT installments AS payment_installments, count(*) AS credit_card_payment_records,
      count(DISTINCT order_id) AS orders_using_installment_count, {_CARD}""",
    "installment_bands": f"""
    SELECT CASE WHEN installments <= 0 THEN 'non_positive'
                WHEN installments = 1 THEN '1_installment'
                WHEN installments BETWEEN 2 AND 3 THEN '2_to_3_installments'
                WHEN installments BETWEEN 4 AND 6 THEN '4_to_6_installments'
                WHEN installments BETWEEN 7 AND 12 THEN '7_to_12_installments'
                ELSE '13_plus_installments' END AS installment_group,
      count(*) AS credit_card_payment_records, {_CARD}""",
    "payments_by_month_and_method": f"""
    WITH x AS (SELECT p.*, strftime(bought, '%Y-%m') AS mon
               FROM m_payments p JOIN m_orders USING (order_id) WHERE {CORE}),
    t AS (SELECT mon, count(DISTINCT order_id) AS o, sum(paid) AS v FROM x GROUP BY ALL),
    g AS (SELECT mon, method, count(DISTINCT order_id) AS o, sum(paid) AS v FROM x GROUP BY ALL)
    SELECT mon AS order_month, method AS payment_type, g.o AS orders_using_method,
      {pct("g.o", "t.o")} AS paid_order_usage_pct, {money("g.v")} AS recorded_payment_value,
      {pct("g.v", "t.v")} AS payment_value_share_pct FROM g JOIN t USING (mon)""",
}


def reconciliation(expected: dict[str, object]) -> str:
    """Eleven checks; expected values come from the caller on both sides."""

    def given(name: str) -> str:
        value = expected.get(name)
        return "NULL" if value is None else f"'{value}'"

    rows = [
        ("completed_orders", given("completed_orders"), "(SELECT count(*) FROM m_done)"),
        ("completed_item_sales_value", given("completed_item_sales_value"),
         "(SELECT sum(price) FROM m_done_items)"),
        ("completed_unique_customers", given("completed_unique_customers"),
         "(SELECT count(*) FROM p)"),
        ("repeat_completed_customers", given("repeat_completed_customers"),
         "(SELECT count(*) FROM p WHERE k > 1)"),
        ("customer_frequency_partition", "(SELECT count(*) FROM p)",
         "(SELECT count(*) FROM p WHERE k >= 1)"),
        ("eligible_delivery_orders", given("eligible_delivery_orders"),
         "(SELECT count(*) FROM m_eligible)"),
        ("late_orders", given("late_orders"), "(SELECT count(*) FROM m_eligible WHERE slip > 0)"),
        ("delivery_status_partition", "(SELECT count(*) FROM m_eligible)",
         "(SELECT count(*) FILTER (slip > 0) + count(*) FILTER (slip <= 0) FROM m_eligible)"),
        ("completed_products", given("completed_products"),
         "(SELECT count(DISTINCT product_id) FROM m_done_items)"),
        ("completed_sellers", given("completed_sellers"),
         "(SELECT count(DISTINCT seller_id) FROM m_done_items)"),
        ("paid_orders", given("paid_orders"), "(SELECT count(DISTINCT order_id) FROM m_payments)"),
    ]
    checks = " UNION ALL ".join(
        f"SELECT {i} AS check_order, '{name}' AS check_name, "
        f"CAST({want} AS DECIMAL(18,2)) AS want, CAST({have} AS DECIMAL(18,2)) AS have"
        for i, (name, want, have) in enumerate(rows, start=1)
    )
    return with_roles(f"""
    WITH p AS (SELECT person, count(DISTINCT order_id) AS k
               FROM m_done JOIN m_customers USING (customer_id) GROUP BY ALL),
    x AS ({checks}),
    s AS (SELECT *, want IS NOT NULL AND want = have AS ok FROM x)
    SELECT check_order, check_name, want::DOUBLE AS expected_value, have::DOUBLE AS actual_value,
      if(ok, 'PASS', 'FAIL') AS validation_status,
      if(bool_and(ok) OVER (), 'ALL CHECKS PASS', 'REVIEW FAILURES') AS overall_validation_status
    FROM s""")


SQL = {name: with_roles(text) for name, text in _SQL.items()}
