"""Expected facts, dimensions, star checks and measures, written for DuckDB."""

from __future__ import annotations

from oracles.roles import big, money, pct, rnd, with_roles

_DAY = "strftime(bought, '%Y-%m-%d') AS order_purchase_date"
_STAMP = "strftime({x}, '%Y-%m-%d %H:%M:%S')"

EXTRA = {
    "m_fo": """
    SELECT o.order_id, c.person, c.state, o.order_status, o.bought, o.arrived, o.due,
      (o.order_status = 'delivered')::INT AS done, (b.n IS NOT NULL)::INT AS has_items,
      coalesce(b.n, 0) AS n, coalesce(b.sales, 0) AS sales,
      (r.order_id IS NOT NULL)::INT AS reviewed, r.score,
      (e.order_id IS NOT NULL)::INT AS eligible, e.took, e.slip
    FROM m_orders o LEFT JOIN m_baskets b USING (order_id)
    LEFT JOIN m_last_review r ON r.order_id = o.order_id
    LEFT JOIN m_customers c USING (customer_id)
    LEFT JOIN m_eligible e ON e.order_id = o.order_id""",
    "m_foc": """
    SELECT o.order_id, o.bought, o.order_status, (o.order_status = 'delivered')::INT AS done,
      l.source, any_value(l.label) AS label, coalesce(l.source, '__unknown__') AS key,
      count(*) AS n, sum(i.price) AS sales,
      (any_value(r.order_id) IS NOT NULL)::INT AS reviewed, any_value(r.score) AS score
    FROM m_items i JOIN m_orders o USING (order_id) JOIN m_labels l USING (product_id)
    LEFT JOIN m_last_review r ON r.order_id = o.order_id
    GROUP BY o.order_id, o.bought, o.order_status, l.source""",
    "m_fso": """
    SELECT i.order_id, i.seller_id, o.bought, o.order_status,
      (o.order_status = 'delivered')::INT AS done, count(*) AS n, sum(i.price) AS sales
    FROM m_items i JOIN m_orders o USING (order_id) GROUP BY ALL""",
    "m_fp": """
    SELECT p.*, o.bought, count(*) OVER w AS records,
      len(list_distinct(list(method) OVER w)) AS methods,
      CASE WHEN method <> 'credit_card' THEN 'not_applicable'
           WHEN installments <= 0 THEN 'non_positive' WHEN installments = 1 THEN '1_installment'
           WHEN installments < 4 THEN '2_to_3_installments'
           WHEN installments < 7 THEN '4_to_6_installments'
           WHEN installments < 13 THEN '7_to_12_installments'
           ELSE '13_plus_installments' END AS band
    FROM m_payments p JOIN m_orders o USING (order_id) WINDOW w AS (PARTITION BY p.order_id)""",
    "m_days": """
    SELECT unnest(generate_series(min(bought)::DATE::TIMESTAMP, max(bought)::DATE::TIMESTAMP,
                                  INTERVAL 1 DAY)) AS d FROM m_orders""",
    "m_cats": "SELECT DISTINCT source, english, label FROM m_labels",
}

_BAND = """CASE WHEN eligible = 0 THEN 'not_eligible' WHEN slip <= 0 THEN 'on_time_or_early'
  WHEN slip <= 3 * 86400 THEN 'over_0_to_3_days_late'
  WHEN slip <= 7 * 86400 THEN 'over_3_to_7_days_late'
  WHEN slip <= 14 * 86400 THEN 'over_7_to_14_days_late'
  WHEN slip <= 30 * 86400 THEN 'over_14_to_30_days_late' ELSE 'over_30_days_late' END"""


def sql(body: str) -> str:
    return with_roles(body, EXTRA)


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


_GRAIN_SOURCES = {
    "fact_orders": ("m_fo", ["order_id"], ["order_id"]),
    "fact_order_categories": ("m_foc", ["order_id", "key"], ["order_id", "category_key"]),
    "fact_seller_orders": ("m_fso", ["order_id", "seller_id"], ["order_id", "seller_id"]),
    "fact_payments": ("m_fp", ["order_id", "seq"], ["order_id", "payment_sequential"]),
    "dim_date": ("m_days", ["d"], ["date"]),
    "dim_category": ("m_cats", ["coalesce(source, '__unknown__')"], ["category_key"]),
    "dim_seller": ("m_sellers", ["seller_id"], ["seller_id"]),
    "dim_customer_state": (
        "(SELECT DISTINCT state FROM m_customers WHERE customer_id IN "
        "(SELECT customer_id FROM m_orders))", ["state"], ["state_code"]),
}
_LINKS = [
    ("fact_orders", "order_purchase_date", "dim_date.date", "m_fo", "bought",
     "SELECT d FROM m_days"),
    ("fact_order_categories", "order_purchase_date", "dim_date.date", "m_foc", "bought",
     "SELECT d FROM m_days"),
    ("fact_seller_orders", "order_purchase_date", "dim_date.date", "m_fso", "bought",
     "SELECT d FROM m_days"),
    ("fact_payments", "order_purchase_date", "dim_date.date", "m_fp", "bought",
     "SELECT d FROM m_days"),
    ("fact_orders", "customer_state", "dim_customer_state.state_code", "m_fo", "state",
     "SELECT state FROM m_customers"),
    ("fact_order_categories", "category_key", "dim_category.category_key", "m_foc", "key",
     "SELECT coalesce(source, '__unknown__') FROM m_cats"),
    ("fact_seller_orders", "seller_id", "dim_seller.seller_id", "m_fso", "seller_id",
     "SELECT seller_id FROM m_sellers"),
]
_TOTALS = {
    "fact_orders": ("m_fo", {
        "rows": "count(*)", "delivered_orders": "sum(done)",
        "orders_without_items": "count(*) FILTER (has_items = 0)",
        "recorded_item_count": "sum(n)", "delivered_item_count": "sum(n) FILTER (done = 1)",
        "recorded_item_sales_value": "sum(sales)",
        "delivered_item_sales_value": "sum(sales) FILTER (done = 1)",
        "orders_with_review": "sum(reviewed)", "delivery_eligible_orders": "sum(eligible)",
        "late_orders": "count(*) FILTER (slip > 0)",
        "on_time_or_early_orders": "count(*) FILTER (slip <= 0)",
    }),
    "fact_order_categories": ("m_foc", {
        "completed_item_count": "sum(n) FILTER (done = 1)",
        "completed_item_sales_value": "sum(sales) FILTER (done = 1)",
        "completed_items_missing_category": "sum(n) FILTER (done = 1 AND source IS NULL)",
    }),
    "fact_seller_orders": ("m_fso", {
        "completed_relationships": "sum(done)",
        "completed_item_count": "sum(n) FILTER (done = 1)",
        "completed_item_sales_value": "sum(sales) FILTER (done = 1)",
    }),
    "fact_payments": ("m_fp", {
        "payment_records": "count(*)", "recorded_payment_value": "sum(paid)",
        "max_payment_records_per_order": "max(records)",
        "max_payment_methods_per_order": "max(methods)",
        "non_positive_card_records": "count(*) FILTER (band = 'non_positive')",
    }),
}


def fact_reconciliation(expected: dict) -> str:
    parts = []
    for fact, (role, metrics) in _TOTALS.items():
        for name, expr in metrics.items():
            want = expected.get((fact, name))
            if want is not None:
                parts.append(
                    f"SELECT '{fact}' AS dataset, '{name}' AS metric, "
                    f"CAST('{want}' AS DECIMAL(18,2)) AS want, "
                    f"(SELECT CAST(coalesce({expr}, 0) AS DECIMAL(18,2)) FROM {role}) AS have")
    return sql(f"""
    SELECT dataset, metric, want::DOUBLE AS expected_value, have::DOUBLE AS actual_value,
      if(want = have, 'PASS', 'FAIL') AS validation_status,
      if(bool_and(want = have) OVER (), 'ALL CHECKS PASS', 'REVIEW FAILURES')
        AS overall_validation_status FROM ({union(parts)})""")


def _r4(num: str, den: str) -> str:
    return rnd(f"({num})::DOUBLE / nullif(({den})::DOUBLE, 0)", 4)


_PERSONS = """
  SELECT state, person, sum(done) AS d, coalesce(sum(sales) FILTER (done = 1), 0) AS v
  FROM m_fo WHERE bought >= '1996-01-01' AND bought < '1996-09-01' GROUP BY ALL"""
_LATE, _ONTIME = "count(*) FILTER (slip > 0)", "count(*) FILTER (slip <= 0)"
_MATCHED = "year(bought) IN (1996, 1997) AND month(bought) <= 8"


def _pair(name: str, a: str, b: str) -> str:
    return (f"{a} AS {name}_1996, {b} AS {name}_1997, "
            f"{pct(f'({b})::DOUBLE - ({a})::DOUBLE', a)} AS {name}_growth_pct")


_SQL = {
    "fact_orders": f"""
    SELECT order_id, person AS customer_unique_id, state AS customer_state, order_status, {_DAY},
      {_STAMP.format(x="bought")} AS order_purchase_timestamp,
      {_STAMP.format(x="arrived")} AS order_delivered_customer_date,
      {_STAMP.format(x="due")} AS order_estimated_delivery_date,
      done AS is_delivered, has_items, n AS item_count, {money("sales")} AS item_sales_value,
      reviewed AS has_review, score AS representative_review_score,
      eligible AS is_delivery_eligible, took::DOUBLE / 86400 AS delivery_days,
      slip::DOUBLE / 86400 AS delivery_variance_days, (slip > 0)::INT AS is_late,
      CASE WHEN slip IS NOT NULL THEN greatest(slip, 0)::DOUBLE / 86400 END AS late_days,
      {_BAND} AS delay_band FROM m_fo""",
    "fact_order_categories": f"""
    SELECT order_id, {_DAY}, order_status, done AS is_delivered, source AS source_category_name,
      label AS category_display_name, key AS category_key, n AS category_item_count,
      {money("sales")} AS category_item_sales_value, reviewed AS has_review,
      score AS representative_review_score FROM m_foc""",
    "fact_seller_orders": f"""
    SELECT order_id, seller_id, {_DAY}, order_status, done AS is_delivered,
      n AS seller_item_count, {money("sales")} AS seller_item_sales_value FROM m_fso""",
    "fact_payments": f"""
    SELECT order_id, seq AS payment_sequential, {_DAY}, method AS payment_type,
      installments AS payment_installments, {money("paid")} AS payment_value,
      records AS payment_record_count, methods AS payment_method_count,
      (records > 1)::INT AS is_multi_payment_order, (methods > 1)::INT AS is_multi_method_order,
      band AS installment_band FROM m_fp""",
    "dim_date": """
    SELECT strftime(d, '%Y-%m-%d') AS date, year(d)::INT AS year, quarter(d)::INT AS quarter_number,
      'Q' || quarter(d) AS quarter, month(d)::INT AS month_number, monthname(d) AS month,
      strftime(d, '%b') AS month_short, strftime(d, '%Y-%m') AS year_month,
      (year(d) * 100 + month(d))::INT AS year_month_sort,
      strftime(date_trunc('month', d), '%Y-%m-%d') AS month_start,
      (d >= '1996-01-01' AND d < '1997-09-01')::INT AS is_core_analysis_period,
      (year(d) IN (1996, 1997) AND month(d) <= 8)::INT AS is_matched_period,
      CASE WHEN year(d) IN (1996, 1997) AND month(d) <= 8 THEN year(d)::INT END
        AS matched_period_year FROM m_days""",
    "dim_category": """
    SELECT coalesce(source, '__unknown__') AS category_key, source AS source_category_name,
      coalesce(english, source, 'Unknown') AS category_display_name,
      CASE WHEN source IS NULL THEN 'missing_source_category'
           WHEN english IS NULL THEN 'untranslated' ELSE 'translated' END AS translation_status
    FROM m_cats""",
    "dim_seller": """
    SELECT seller_id, city AS seller_city, state AS seller_state FROM m_sellers""",
    "dim_customer_state": """
    SELECT DISTINCT state AS state_code FROM m_customers
    WHERE customer_id IN (SELECT customer_id FROM m_orders)""",
    "star_grain_checks": "SELECT *, if(total_rows = unique_combinations AND missing_key_rows = 0,"
    " 'PASS', 'FAIL') AS status FROM (" + union(
        f"SELECT '{name}' AS dataset, '{' + '.join(labels)}' AS key_columns, "
        f"count(*) AS total_rows, count(DISTINCT ({', '.join(keys)})) AS unique_combinations, "
        f"count(*) FILTER (({' OR '.join(k + ' IS NULL' for k in keys)})) AS missing_key_rows "
        f"FROM {role}" for name, (role, keys, labels) in _GRAIN_SOURCES.items()) + ")",
    "star_link_checks": "SELECT *, if(orphan_rows = 0, 'PASS', 'FAIL') AS status FROM (" + union(
        f"SELECT '{fact}.{key} -> {target}' AS link, count(*) AS orphan_rows FROM {role} "
        f"WHERE {column} IS NOT NULL AND {column} NOT IN ({members})"
        for fact, key, target, role, column, members in _LINKS) + ")",
    "star_calendar_check": """
    SELECT count(*) AS days, count(DISTINCT d) AS distinct_days,
      date_diff('day', min(d), max(d)) + 1 AS span_days,
      if(count(*) = date_diff('day', min(d), max(d)) + 1, 'PASS', 'FAIL') AS status FROM m_days""",
    "measures_marketplace": f"""
    SELECT state AS customer_state, count(*) AS recorded_orders, {big("sum(done)")} AS completed_orders,
      {_r4("sum(done)", "count(*)")} AS completion_rate, {big("sum(n)")} AS recorded_items,
      {big("coalesce(sum(n) FILTER (done = 1), 0)")} AS completed_items,
      {money("sum(sales)")} AS recorded_item_sales_value,
      {money("coalesce(sum(sales) FILTER (done = 1), 0)")} AS completed_item_sales_value,
      {_r4("coalesce(sum(sales) FILTER (done = 1), 0)", "sum(done)")}
        AS avg_item_sales_value_per_completed_order
    FROM m_fo GROUP BY state""",
    "measures_customers": f"""
    WITH p AS ({_PERSONS})
    SELECT state AS customer_state, count(person) AS recorded_unique_customers,
      count(*) FILTER (d > 0) AS completed_unique_customers,
      count(*) FILTER (d > 1) AS observed_repeat_customers,
      {_r4("count(*) FILTER (d > 1)", "count(*) FILTER (d > 0)")} AS observed_repeat_customer_rate,
      count(*) FILTER (d = 1) AS one_time_completed_customers,
      {big("coalesce(sum(d) FILTER (d > 1), 0)")} AS repeat_customer_completed_orders,
      {_r4("coalesce(sum(d) FILTER (d > 1), 0)", "sum(d)")} AS repeat_customer_order_share,
      {money("coalesce(sum(v) FILTER (d = 1), 0)")} AS one_time_customer_item_sales_value,
      {money("coalesce(sum(v) FILTER (d > 1), 0)")} AS repeat_customer_item_sales_value,
      {_r4("coalesce(sum(v) FILTER (d > 1), 0)", "sum(v)")}
        AS repeat_customer_item_sales_value_share,
      {_r4("sum(d)", "count(*) FILTER (d > 0)")} AS avg_completed_orders_per_customer,
      {_r4("coalesce(sum(d) FILTER (d > 1), 0)", "count(*) FILTER (d > 1)")}
        AS avg_completed_orders_per_repeat_customer
    FROM p GROUP BY state""",
    "measures_delivery_reviews": f"""
    SELECT {_BAND} AS delay_band, {big("sum(eligible)")} AS delivery_eligible_orders,
      {_ONTIME} AS on_time_or_early_orders, {_LATE} AS late_orders,
      {_r4(_LATE, "sum(eligible)")} AS late_delivery_rate,
      {rnd("sum(took)::DOUBLE / nullif(sum(eligible), 0)::DOUBLE / 86400", 4)} AS avg_delivery_days,
      {rnd(f"(sum(slip) FILTER (slip > 0))::DOUBLE / nullif({_LATE}, 0) / 86400", 4)}
        AS avg_late_days,
      {big("sum(reviewed)")} AS reviewed_orders, {_r4("sum(score)", "count(score)")} AS avg_review_score,
      count(*) FILTER (score <= 2) AS low_review_orders,
      {_r4("count(*) FILTER (score <= 2)", "sum(reviewed)")} AS low_review_rate,
      count(*) FILTER (score >= 4) AS high_review_orders,
      {_r4("count(*) FILTER (score >= 4)", "sum(reviewed)")} AS high_review_rate
    FROM m_fo GROUP BY ALL""",
    "measures_categories": f"""
    WITH x AS (SELECT * FROM m_foc WHERE bought >= '1996-01-01' AND bought < '1997-09-01')
    SELECT key AS category_key, label AS category_display_name,
      count(DISTINCT order_id) FILTER (done = 1) AS category_completed_orders,
      {big("coalesce(sum(n) FILTER (done = 1), 0)")} AS category_items_sold,
      {money("coalesce(sum(sales) FILTER (done = 1), 0)")} AS category_item_sales_value,
      {_r4("coalesce(sum(sales) FILTER (done = 1), 0)",
           "(SELECT sum(sales) FROM x WHERE done = 1)")} AS category_marketplace_share,
      {_r4("sum(score)", "count(score)")} AS category_avg_review_score,
      {_r4("count(*) FILTER (score <= 2)", "sum(reviewed)")} AS category_low_review_rate
    FROM x WHERE key IN ('ECONOMY', 'SMALL', '__unknown__') GROUP BY ALL""",
    "measures_sellers": f"""
    SELECT count(DISTINCT seller_id) FILTER (done = 1) AS active_sellers,
      {big("sum(done)")} AS seller_order_relationships,
      {big("sum(n) FILTER (done = 1)")} AS seller_items_sold,
      {money("sum(sales) FILTER (done = 1)")} AS seller_item_sales_value,
      {_r4("sum(done)", "count(DISTINCT seller_id) FILTER (done = 1)")} AS avg_seller_orders,
      {_r4("sum(sales) FILTER (done = 1)", "count(DISTINCT seller_id) FILTER (done = 1)")}
        AS avg_item_sales_value_per_seller
    FROM m_fso JOIN m_sellers USING (seller_id)
    WHERE state IN ('NATION_3', 'NATION_7', 'NATION_15', 'NATION_20')""",
    "measures_payments": f"""
    SELECT count(DISTINCT order_id) AS paid_orders, count(*) AS payment_records,
      {money("sum(paid)")} AS recorded_payment_value,
      {_r4("count(*)", "count(DISTINCT order_id)")} AS avg_payment_records_per_paid_order,
      count(DISTINCT order_id) FILTER (records > 1) AS multi_payment_orders,
      {_r4("count(DISTINCT order_id) FILTER (records > 1)", "count(DISTINCT order_id)")}
        AS multi_payment_order_rate,
      count(DISTINCT order_id) FILTER (methods > 1) AS mixed_method_orders,
      {_r4("count(DISTINCT order_id) FILTER (methods > 1)", "count(DISTINCT order_id)")}
        AS mixed_method_order_rate,
      count(*) FILTER (method = 'credit_card') AS credit_card_payment_records,
      count(*) FILTER (method = 'credit_card' AND installments > 1)
        AS multi_installment_credit_card_records,
      {_r4("count(*) FILTER (method = 'credit_card' AND installments > 1)",
           "count(*) FILTER (method = 'credit_card')")} AS multi_installment_rate,
      {_r4("sum(paid) FILTER (method = 'credit_card')",
           "count(*) FILTER (method = 'credit_card')")} AS avg_credit_card_payment_value
    FROM m_fp""",
    "measures_payment_methods": f"""
    SELECT method AS payment_type, count(DISTINCT order_id) AS orders_using_payment_method,
      {_r4("count(DISTINCT order_id)", "(SELECT count(DISTINCT order_id) FROM m_fp)")}
        AS payment_method_order_usage_rate,
      {money("sum(paid)")} AS payment_value_by_method,
      {_r4("sum(paid)", "(SELECT sum(paid) FROM m_fp)")} AS payment_value_share
    FROM m_fp WHERE method <> 'voucher' GROUP BY method""",
    "measures_matched": "WITH y AS (SELECT year(bought) AS y, sum(done) AS o, "
    "sum(sales) FILTER (done = 1) AS v FROM m_fo WHERE " + _MATCHED + " GROUP BY ALL), "
    "w AS (SELECT max(o) FILTER (y = 1996) AS o1, max(o) FILTER (y = 1997) AS o2, "
    "max(v) FILTER (y = 1996) AS v1, max(v) FILTER (y = 1997) AS v2 FROM y) SELECT "
    + _pair("completed_orders", big("o1"), big("o2")) + ", "
    + _pair("completed_item_sales_value", money("v1"), money("v2")).replace(
        pct(f"({money('v2')})::DOUBLE - ({money('v1')})::DOUBLE", money("v1")),
        pct("v2::DOUBLE - v1::DOUBLE", "v1")) + " FROM w",
    "measures_matched_customers": "WITH p AS (SELECT year(bought) AS y, person, sum(done) AS d "
    "FROM m_fo WHERE " + _MATCHED + " GROUP BY ALL), w AS (SELECT "
    "count(*) FILTER (y = 1996 AND d > 0) AS a1, count(*) FILTER (y = 1997 AND d > 0) AS a2, "
    "count(*) FILTER (y = 1996 AND d > 1) AS r1, count(*) FILTER (y = 1997 AND d > 1) AS r2 "
    "FROM p) SELECT " + _pair("completed_unique_customers", "a1", "a2") + ", "
    + _pair("observed_repeat_customers", "r1", "r2") + " FROM w",
    "measures_category_matched": f"""
    WITH g AS (SELECT key, label,
        coalesce(sum(sales) FILTER (done = 1 AND year(bought) = 1996), 0) AS a,
        coalesce(sum(sales) FILTER (done = 1 AND year(bought) = 1997), 0) AS b
      FROM m_foc WHERE {_MATCHED} GROUP BY ALL),
    t AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM g)
    SELECT key AS category_key, label AS category_display_name,
      {money("a")} AS item_sales_value_1996, {money("b")} AS item_sales_value_1997,
      {money("b - a")} AS absolute_growth, {pct("b - a", "a")} AS growth_pct,
      {pct("a", "ta")} AS marketplace_share_1996_pct, {pct("b", "tb")} AS marketplace_share_1997_pct,
      {rnd("100 * (b::DOUBLE / tb::DOUBLE - a::DOUBLE / ta::DOUBLE)")} AS share_change_pp,
      {pct("b - a", "tb - ta")} AS growth_contribution_pct FROM t""",
}

SQL = {name: sql(text) for name, text in _SQL.items()}

# the same measures over all rows: each filter above is taken out of its query
_ALL = {
    "measures_customers": " WHERE bought >= '1996-01-01' AND bought < '1996-09-01'",
    "measures_categories": " WHERE key IN ('ECONOMY', 'SMALL', '__unknown__')",
    "measures_sellers": "\n    WHERE state IN ('NATION_3', 'NATION_7', 'NATION_15', 'NATION_20')",
    "measures_payment_methods": " WHERE method <> 'voucher'",
}
for _name, _filter in _ALL.items():
    assert _filter in SQL[_name]
    SQL[f"{_name}_all"] = SQL[_name].replace(_filter, "")
SQL["measures_categories_all"] = SQL["measures_categories_all"].replace(
    " WHERE bought >= '1996-01-01' AND bought < '1997-09-01'", "")

_MONTHLY = union(
    f"SELECT strftime(bought, '%Y-%m') AS purchase_month, done AS is_delivered, '{name}' AS fact, "
    f"n, sales FROM {role}"
    for name, role in (("order", "m_fo"), ("category", "m_foc"), ("seller", "m_fso")))
SQL["star_cross_fact_check"] = sql(f"""
SELECT *, if(order_items = category_items AND order_items = seller_items
    AND order_sales = category_sales AND order_sales = seller_sales, 'PASS', 'FAIL') AS status
FROM (SELECT purchase_month, is_delivered, """ + ", ".join(
    f"coalesce(sum({column}) FILTER (fact = '{name}'), 0)::{kind} AS {name}_{value}"
    for value, column, kind in (("items", "n", "BIGINT"), ("sales", "sales", "DOUBLE"))
    for name in ("order", "category", "seller")) + f"""
FROM ({_MONTHLY}) GROUP BY ALL HAVING sum(n) > 0)""")


def _orders_where(test: str) -> str:
    return SQL["measures_marketplace"].replace(
        "FROM m_fo GROUP BY", f"FROM (SELECT * FROM m_fo WHERE {test}) x GROUP BY")


SQL["measures_in_month"] = _orders_where("bought >= '1996-03-01' AND bought < '1996-04-01'")
SQL["measures_in_year"] = _orders_where("year(bought) = 1996")
SQL["measures_in_state"] = _orders_where("state IN ('NATION_3', 'NATION_7')")
SQL["measures_in_category"] = SQL["measures_categories"].replace(
    "IN ('ECONOMY', 'SMALL', '__unknown__')", "= 'ECONOMY'")
SQL["measures_in_seller_state"] = SQL["measures_sellers"]
SQL["measures_isolated"] = SQL["measures_marketplace"]


def _reviews_where(test: str) -> str:
    """The delivery and review measures by state, for the orders that meet the test."""
    by_state = SQL["measures_delivery_reviews"].replace(f"{_BAND} AS delay_band", "state AS customer_state")
    return by_state.replace("FROM m_fo GROUP BY ALL", f"FROM (SELECT * FROM m_fo WHERE {test}) x GROUP BY state")


SQL["measures_reviews_in_month"] = _reviews_where("bought >= '1996-03-01' AND bought < '1996-04-01'")
SQL["measures_reviews_in_year"] = _reviews_where("year(bought) = 1996")
SQL["measures_reviews_in_state"] = _reviews_where("state IN ('NATION_3', 'NATION_7')")
SQL["measures_reviews_isolated"] = _reviews_where("true")


SQL["star_integrity"] = sql(
    "SELECT *, if(faults = 0, 'PASS', 'FAIL') AS status FROM (" + union([
        *(f"SELECT 'grain' AS \"check\", '{name} ({', '.join(labels)})' AS subject, "
          f"count(*) - count(DISTINCT ({', '.join(keys)})) "
          f"+ count(*) FILTER (({' OR '.join(k + ' IS NULL' for k in keys)})) AS faults FROM {role}"
          for name, (role, keys, labels) in _GRAIN_SOURCES.items()),
        *(f"SELECT 'link', '{fact}.{key} -> {target}', count(*) FROM {role} "
          f"WHERE {column} IS NOT NULL AND {column} NOT IN ({members})"
          for fact, key, target, role, column, members in _LINKS),
    ]) + ")")

SQL["fact_refresh"] = sql(union(
    f"""SELECT '{name}' AS fact, strftime(bought, '%Y-%m') AS purchase_month, count(*) AS "rows",
      if(strftime(bought, '%Y-%m') >= '1998-01', 'late', 'first') AS load FROM {role} GROUP BY ALL"""
    for name, (role, _, _) in list(_GRAIN_SOURCES.items())[:4]))
