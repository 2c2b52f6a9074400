"""Expected comparison of measures with reports: both sides in DuckDB, one query per side and area."""

from __future__ import annotations

from oracles import reports
from oracles.star import sql, union

_LATE = "count(*) FILTER (slip > 0)"
_CORE = "bought >= '1996-01-01' AND bought < '1997-09-01'"
_SALES_DONE = "coalesce(sum(sales) FILTER (done = 1), 0)"
_ITEMS_DONE = "coalesce(sum(n) FILTER (done = 1), 0)"
_PERSON = "SELECT {m} AS member, person, sum(done) AS d FROM m_fo {w} GROUP BY ALL"

_ORDERS = {
    "recorded_orders": "count(*)",
    "completed_orders": "sum(done)",
    "recorded_items": "sum(n)",
    "completed_items": _ITEMS_DONE,
    "completed_item_sales_value": _SALES_DONE,
    "avg_item_sales_value_per_completed_order": f"{_SALES_DONE}::DOUBLE / nullif(sum(done), 0)::DOUBLE",
    "completed_order_rate_pct": "100 * sum(done)::DOUBLE / count(*)",
}
_COUNTED = {
    "recorded_unique_customers": "count(person)",
    "completed_unique_customers": "count(*) FILTER (d > 0)",
}
_REPEAT = {
    "completed_repeat_customers": "count(*) FILTER (d > 1)",
    "completed_repeat_customer_rate_pct":
        "100 * (count(*) FILTER (d > 1))::DOUBLE / nullif(count(*) FILTER (d > 0), 0)",
    "completed_orders_from_repeat_customers": "coalesce(sum(d) FILTER (d > 1), 0)",
    "completed_order_share_from_repeat_customers_pct":
        "100 * coalesce(sum(d) FILTER (d > 1), 0)::DOUBLE / nullif(sum(d), 0)::DOUBLE",
    "avg_completed_orders_per_customer": "sum(d)::DOUBLE / nullif(count(*) FILTER (d > 0), 0)",
    "avg_completed_orders_per_repeat_customer":
        "coalesce(sum(d) FILTER (d > 1), 0)::DOUBLE / nullif(count(*) FILTER (d > 1), 0)",
}
_DELIVERY = {
    "eligible_delivered_orders": "sum(eligible)",
    "late_orders": _LATE,
    "late_delivery_rate_pct": f"100 * {_LATE}::DOUBLE / nullif(sum(eligible), 0)",
    "avg_delivery_days": "sum(took)::DOUBLE / nullif(sum(eligible), 0)::DOUBLE / 86400",
    "avg_delay_days_for_late_orders": f"(sum(slip) FILTER (slip > 0))::DOUBLE / nullif({_LATE}, 0) / 86400",
}
_PAID = "count(DISTINCT order_id)"
_SEVERAL, _MIXED = f"{_PAID} FILTER (records > 1)", f"{_PAID} FILTER (methods > 1)"
_MONTH = "strftime(bought, '%Y-%m')"

# area, report, its member column, rows of the fact, member over them, figures
_AREAS = [
    ("marketplace", "marketplace_scale", None, "m_fo", None,
     {**_ORDERS, "recorded_item_sales_value": "sum(sales)"}),
    ("marketplace", "marketplace_scale", None, f"({_PERSON.format(m=1, w='')})", None, _COUNTED),
    ("month", "monthly_trends", "order_month", f"(SELECT * FROM m_fo WHERE {_CORE})", _MONTH, _ORDERS),
    ("month", "monthly_trends", "order_month", f"({_PERSON.format(m=_MONTH, w='WHERE ' + _CORE)})",
     "member", _COUNTED),
    ("repeat customers", "customer_base_repeat", None, f"({_PERSON.format(m=1, w='')})", None, _REPEAT),
    ("delivery", "delivery_reliability", None, "m_fo", None,
     {**_DELIVERY, "on_time_or_early_orders": "count(*) FILTER (slip <= 0)"}),
    ("delivery by customer state", "delivery_by_state", "customer_state", "m_fo", "state", _DELIVERY),
    ("customer state", "customer_geography", "customer_state", "m_fo", "state",
     {"completed_items": _ITEMS_DONE, "completed_item_sales_value": _SALES_DONE}),
    ("category", "category_performance", "category_name", "m_foc", "label",
     {"items_sold": _ITEMS_DONE, "item_sales_value": _SALES_DONE}),
    ("sellers", "seller_population", None, "m_fso", None,
     {"active_sellers": "count(DISTINCT seller_id) FILTER (done = 1)",
      "seller_order_relationships": "sum(done)", "completed_items": _ITEMS_DONE,
      "completed_item_sales_value": _SALES_DONE}),
    ("payments", "payment_population", None, "m_fp", None,
     {"orders_with_payments": _PAID, "payment_records": "count(*)", "recorded_payment_value": "sum(paid)",
      "multiple_payment_record_orders": _SEVERAL,
      "multiple_payment_record_order_pct": f"100 * ({_SEVERAL})::DOUBLE / {_PAID}",
      "multiple_payment_method_orders": _MIXED,
      "multiple_payment_method_order_pct": f"100 * ({_MIXED})::DOUBLE / {_PAID}",
      "avg_payment_records_per_paid_order": f"count(*)::DOUBLE / {_PAID}"}),
    ("payment method", "payment_method_mix", "payment_type", "m_fp", "method",
     {"orders_using_method": _PAID,
      "paid_order_usage_pct": f"100 * {_PAID}::DOUBLE / (SELECT {_PAID} FROM m_fp)",
      "recorded_payment_value": "sum(paid)",
      "payment_value_share_pct": "100 * sum(paid)::DOUBLE / (SELECT sum(paid) FROM m_fp)::DOUBLE"}),
]


def _cells(figures: dict) -> str:
    return "unnest([" + ", ".join(
        f"{{metric: '{name}', v: ({value})::DOUBLE}}" for name, value in figures.items()) + "]) AS x"


def _sides():
    for area, report, column, rows, member, figures in _AREAS:
        theirs = f"coalesce({column}::VARCHAR, '(none)')" if column else "'all'"
        ours = f"coalesce({member}::VARCHAR, '(none)')" if member else "'all'"
        named = {metric: metric for metric in figures}
        yield (f"SELECT '{area}' AS area, member, x.metric AS metric, x.v AS r, NULL::DOUBLE AS m "
               f"FROM (SELECT {theirs} AS member, {_cells(named)} FROM ({reports.SQL[report]}))")
        yield (f"SELECT '{area}', member, x.metric, NULL, x.v FROM (SELECT {ours} AS member, "
               f"{_cells(figures)} FROM {rows}" + (f" GROUP BY {ours})" if member else ")"))


def _rounded(value: str) -> str:
    return f"round(CAST(({value}) AS DECIMAL(30,9)), 2)::DOUBLE"


RECONCILIATION = sql(f"""
    SELECT area, member, metric, {_rounded("r")} AS report_value, {_rounded("m")} AS measure_value,
      if(abs(r - m) <= 0.005 + 1e-9, 'PASS', 'FAIL') AS status
    FROM (SELECT area, member, metric, coalesce(sum(r), 0) AS r, coalesce(sum(m), 0) AS m
          FROM ({union(_sides())}) GROUP BY ALL)""")
