"""Measures of the star held against the reports, which take another way to the same figures.

The reports start from the cleaned tables, the measures from the facts, so equal figures say that
the facts were built whole and that the measures mean what the reports say. No expected
values are needed, so the check holds for any data set. Everything is compared member by member
(month, state, category, payment method), after both sides were aggregated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarscope.functions import metrics as M
from bazaarscope.functions.periods import Periods
from bazaarscope.operators.profile import union_all
from bazaarscope.plans import categories, customers, delivery, marketplace, measures, payments, sellers
from bazaarscope.plans.facts import Star
from bazaarscope.sources.model import Marketplace

c = F.col
# reports round to two digits
TOLERANCE = 0.005 + 1e-9
ALL = "all"

Report = Callable[[Marketplace, Periods], DataFrame]


@dataclass(frozen=True)
class Comparison:
    """``pairs`` maps a column of the report to a measure, or to a measure and a factor.

    ``member`` is the column of the report that names its groups, ``by`` is an expression for the same over the fact.
    Groups that carry one name, as categories may, are added up, so only sums fit there.
    """

    area: str
    report: Report
    fact: str
    pairs: Mapping[str, str | tuple[str, int]]
    member: str | None = None
    by: str | None = None
    where: Callable[[Periods], Column] | None = None

    def measure(self, column: str) -> tuple[str, int]:
        found = self.pairs[column]
        return (found, 1) if isinstance(found, str) else found


_MONTH = "date_format(order_purchase_date, 'yyyy-MM')"


def _core(periods: Periods) -> Column:
    return periods.in_core(c("order_purchase_date").cast("timestamp_ntz"))


_ORDER_SUMS = {
    "recorded_orders": "recorded_orders",
    "completed_orders": "completed_orders",
    "recorded_items": "recorded_items",
    "completed_items": "completed_items",
    "completed_item_sales_value": "completed_item_sales_value",
    "avg_item_sales_value_per_completed_order": "avg_item_sales_value_per_completed_order",
    "completed_order_rate_pct": ("completion_rate", 100),
}
_PERSON_COUNTS = {
    "recorded_unique_customers": "recorded_unique_customers",
    "completed_unique_customers": "completed_unique_customers",
}
_DELIVERY = {
    "eligible_delivered_orders": "delivery_eligible_orders",
    "late_orders": "late_orders",
    "late_delivery_rate_pct": ("late_delivery_rate", 100),
    "avg_delivery_days": "avg_delivery_days",
    "avg_delay_days_for_late_orders": "avg_late_days",
}

COMPARISONS = (
    Comparison(
        "marketplace", lambda mk, _: marketplace.scale(mk), "fact_orders",
        {**_ORDER_SUMS, "recorded_item_sales_value": "recorded_item_sales_value"},
    ),
    Comparison("marketplace", lambda mk, _: marketplace.scale(mk), "persons", _PERSON_COUNTS),
    Comparison("month", marketplace.monthly_trends, "fact_orders", _ORDER_SUMS, "order_month", _MONTH, _core),
    Comparison("month", marketplace.monthly_trends, "persons", _PERSON_COUNTS, "order_month", _MONTH, _core),
    Comparison(
        "repeat customers", lambda mk, _: customers.base_and_repeat(mk), "persons",
        {
            "completed_repeat_customers": "observed_repeat_customers",
            "completed_repeat_customer_rate_pct": ("observed_repeat_customer_rate", 100),
            "completed_orders_from_repeat_customers": "repeat_customer_completed_orders",
            "completed_order_share_from_repeat_customers_pct": ("repeat_customer_order_share", 100),
            "avg_completed_orders_per_customer": "avg_completed_orders_per_customer",
            "avg_completed_orders_per_repeat_customer": "avg_completed_orders_per_repeat_customer",
        },
    ),
    Comparison(
        "delivery", lambda mk, _: delivery.reliability(mk), "fact_orders",
        {**_DELIVERY, "on_time_or_early_orders": "on_time_or_early_orders"},
    ),
    Comparison(
        "delivery by customer state", lambda mk, _: delivery.by_state(mk), "fact_orders", _DELIVERY,
        "customer_state", "customer_state",
    ),
    Comparison(
        # orders stay out: this report counts those with items only
        "customer state", lambda mk, _: customers.geography(mk), "fact_orders",
        {name: name for name in ("completed_items", "completed_item_sales_value")},
        "customer_state", "customer_state",
    ),
    Comparison(
        "category", lambda mk, _: categories.performance(mk), "fact_order_categories",
        {
            "items_sold": "category_items_sold",
            "item_sales_value": "category_item_sales_value",
        },
        "category_name", "category_display_name",
    ),
    Comparison(
        "sellers", lambda mk, _: sellers.population(mk), "fact_seller_orders",
        {
            "active_sellers": "active_sellers",
            "seller_order_relationships": "seller_order_relationships",
            "completed_items": "seller_items_sold",
            "completed_item_sales_value": "seller_item_sales_value",
        },
    ),
    Comparison(
        "payments", lambda mk, _: payments.population(mk), "fact_payments",
        {
            "orders_with_payments": "paid_orders",
            "payment_records": "payment_records",
            "recorded_payment_value": "recorded_payment_value",
            "multiple_payment_record_orders": "multi_payment_orders",
            "multiple_payment_record_order_pct": ("multi_payment_order_rate", 100),
            "multiple_payment_method_orders": "mixed_method_orders",
            "multiple_payment_method_order_pct": ("mixed_method_order_rate", 100),
            "avg_payment_records_per_paid_order": "avg_payment_records_per_paid_order",
        },
    ),
    Comparison(
        "payment method", lambda mk, _: payments.method_mix(mk), "fact_payments",
        {
            "orders_using_method": "orders_using_payment_method",
            "paid_order_usage_pct": ("payment_method_order_usage_rate", 100),
            "recorded_payment_value": "payment_value_by_method",
            "payment_value_share_pct": ("payment_value_share", 100),
        },
        "payment_type", "payment_type",
    ),
)


def _long(rows: DataFrame, area: str, member: Column, values: Mapping[str, Column], side: str) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
        for name, value in values.items()
    ]
    named = F.coalesce(member.cast("string"), F.lit("(none)")).alias("member")
    long = rows.select(F.lit(area).alias("area"), named, F.inline(F.array(*cells)))
    return long.select("area", "member", "metric", F.lit(side).alias("side"), "value")


def _both_sides(comparison: Comparison, mk: Marketplace, star: Star, periods: Periods) -> list[DataFrame]:
    grouped = comparison.member is not None
    report = comparison.report(mk, periods)
    expected = _long(
        report, comparison.area, c(comparison.member) if grouped else F.lit(ALL),
        {name: c(name) for name in comparison.pairs}, "report",
    )
    fact = "fact_orders" if comparison.fact == "persons" else comparison.fact
    rows = star[fact]
    # a fact's own column keeps its name, as shares lift it by that name
    by = "payment_type" if comparison.member == "payment_type" else "_member_name"
    if grouped and by not in rows.columns:
        rows = rows.withColumn(by, F.expr(comparison.by))
    found = measures.evaluate(
        Star({fact: rows}), [comparison.measure(name)[0] for name in comparison.pairs],
        [by] if grouped else [], comparison.where(periods) if comparison.where else None,
    )
    values = {}
    for name in comparison.pairs:
        measure, factor = comparison.measure(name)
        values[name] = c(measure) * factor
    return [expected, _long(found, comparison.area, c(by) if grouped else F.lit(ALL), values, "measure")]


def reconciliation(
    mk: Marketplace, star: Star, periods: Periods, comparisons: Sequence[Comparison] = COMPARISONS
) -> DataFrame:
    """``area, member, metric, report_value, measure_value, status`` of every figure of both ways.

    A member that one side lacks counts as 0 there: reports leave out members without completed
    orders. No value is 0 too.
    """
    sides = union_all([part for x in comparisons for part in _both_sides(x, mk, star, periods)])

    def of(side: str) -> Column:
        return F.coalesce(F.sum(F.when(c("side") == side, c("value"))), F.lit(0.0))

    rows = sides.groupBy("area", "member", "metric").agg(
        of("report").alias("report_value"), of("measure").alias("measure_value")
    )
    equal = F.abs(c("report_value") - c("measure_value")) <= TOLERANCE
    return rows.select(
        "area", "member", "metric", M.rounded(c("report_value")).alias("report_value"),
        M.rounded(c("measure_value")).alias("measure_value"),
        F.when(equal, "PASS").otherwise("FAIL").alias("status"),
    )
