"""Reconciles critical metrics with expected values that are passed in as data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarscope.functions import metrics as M
from bazaarscope.operators.members import member_counts
from bazaarscope.plans import base as B
from bazaarscope.sources.model import Marketplace

c = F.col

# name of the check -> None where both sides come from the data
CHECKS = (
    "completed_orders",
    "completed_item_sales_value",
    "completed_unique_customers",
    "repeat_completed_customers",
    "customer_frequency_partition",
    "eligible_delivery_orders",
    "late_orders",
    "delivery_status_partition",
    "completed_products",
    "completed_sellers",
    "paid_orders",
)

# -- fixed values: published results on the original data set ---------------------
PUBLISHED = {
    "completed_orders": "96478.00",
    "completed_item_sales_value": "13221498.11",
    "completed_unique_customers": "93358.00",
    "repeat_completed_customers": "2801.00",
    "eligible_delivery_orders": "96470.00",
    "late_orders": "7826.00",
    "completed_products": "32216.00",
    "completed_sellers": "2970.00",
    "paid_orders": "99440.00",
}


def metric_row(mk: Marketplace) -> DataFrame:
    """All metrics of the reconciliation in one row."""
    late = M.is_late()
    eligible = M.is_delivery_eligible()
    orders = mk.orders.agg(
        M.rows_where(M.is_completed()).alias("completed_orders"),
        M.rows_where(eligible).alias("eligible"),
        M.rows_where(eligible & late).alias("late"),
        M.rows_where(eligible & ~late).alias("on_time"),
    )
    people = (
        B.completed_orders(mk)
        .groupBy("customer_id")
        .agg(F.count("*").alias("n"))
        .join(B.customer_people(mk), "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.sum("n").alias("n"))
        .agg(
            F.struct(
                F.count("*").alias("all"),
                M.rows_where(c("n") == 1).alias("one_time"),
                M.rows_where(c("n") > 1).alias("repeat"),
            ).alias("p")
        )
    )
    items = member_counts(
        B.completed_items(mk, ["product_id", "seller_id", "price"]),
        [],
        {"products": "product_id", "sellers": "seller_id"},
        {"sales": M.cents_sum("price")},
    )
    items = items.select(F.struct(*items.columns).alias("i"))
    paid = mk.payments.agg(F.count_distinct("order_id").alias("paid"))
    return orders.select(
        "*",
        people.scalar().alias("p"),
        items.scalar().alias("i"),
        paid.scalar().alias("paid"),
    )


def reconciliation(mk: Marketplace, expected: Mapping[str, object]) -> DataFrame:
    """One row per check with expected and actual value, PASS or FAIL, and an overall status.

    ``expected`` maps check names to values; the partition checks need none.
    """

    def given(name: str) -> Column:
        value = expected.get(name)
        return F.lit(None if value is None else str(value))

    sides = {
        "completed_orders": (given("completed_orders"), c("completed_orders")),
        "completed_item_sales_value": (given("completed_item_sales_value"), c("i.sales") / 100),
        "completed_unique_customers": (given("completed_unique_customers"), c("p.all")),
        "repeat_completed_customers": (given("repeat_completed_customers"), c("p.repeat")),
        "customer_frequency_partition": (c("p.all"), c("p.one_time") + c("p.repeat")),
        "eligible_delivery_orders": (given("eligible_delivery_orders"), c("eligible")),
        "late_orders": (given("late_orders"), c("late")),
        "delivery_status_partition": (c("eligible"), c("on_time") + c("late")),
        "completed_products": (given("completed_products"), c("i.products")),
        "completed_sellers": (given("completed_sellers"), c("i.sellers")),
        "paid_orders": (given("paid_orders"), c("paid")),
    }
    money = "decimal(18,2)"
    checks = [
        F.struct(
            F.lit(position).alias("check_order"),
            F.lit(name).alias("check_name"),
            sides[name][0].cast(money).alias("expected_value"),
            sides[name][1].cast(money).alias("actual_value"),
        )
        for position, name in enumerate(CHECKS, start=1)
    ]
    return with_status(
        metric_row(mk).select(F.inline(F.array(*checks))), "expected_value", "actual_value"
    ).select(
        "check_order",
        "check_name",
        c("expected_value").cast("double").alias("expected_value"),
        c("actual_value").cast("double").alias("actual_value"),
        "validation_status",
        "overall_validation_status",
    )


def with_status(checks: DataFrame, expected: str, actual: str) -> DataFrame:
    """Add PASS or FAIL per check and whether all passed; one row per check."""
    equal = c(expected).isNotNull() & (c(expected) == c(actual))
    judged = checks.withColumn("validation_status", F.when(equal, "PASS").otherwise("FAIL"))
    failures = F.sum((c("validation_status") == "FAIL").cast("int")).over(Window.partitionBy())
    return judged.withColumn(
        "overall_validation_status",
        F.when(failures == 0, "ALL CHECKS PASS").otherwise("REVIEW FAILURES"),
    )
