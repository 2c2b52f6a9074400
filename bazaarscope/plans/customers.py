"""Customer base, frequency, repeat behaviour, value deciles and geography."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarscope.functions import metrics as M
from bazaarscope.operators.ordered import ntile_totals
from bazaarscope.plans import base as B
from bazaarscope.sources.model import Marketplace

c = F.col


def _orders_per_person(mk: Marketplace) -> DataFrame:
    return (
        B.orders_per_customer_record(mk)
        .join(B.customer_people(mk), "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            F.sum("recorded_orders").alias("recorded_orders"),
            F.sum("completed_orders").alias("completed_orders"),
        )
    )


def base_and_repeat(mk: Marketplace) -> DataFrame:
    recorded, completed = c("recorded_orders"), c("completed_orders")
    row = _orders_per_person(mk).agg(
        F.count("*").alias("recorded_people"),
        M.rows_where(recorded > 1).alias("recorded_repeat"),
        M.rows_where(completed > 0).alias("people"),
        M.rows_where(completed > 1).alias("repeat"),
        F.sum(completed).alias("orders"),
        M.sum_where(completed > 1, completed).alias("repeat_orders"),
    )
    return row.select(
        c("recorded_people").alias("recorded_unique_customers"),
        c("recorded_repeat").alias("recorded_repeat_customers"),
        M.pct(c("recorded_repeat"), c("recorded_people")).alias(
            "recorded_repeat_customer_rate_pct"
        ),
        c("people").alias("completed_unique_customers"),
        c("repeat").alias("completed_repeat_customers"),
        M.pct(c("repeat"), c("people")).alias("completed_repeat_customer_rate_pct"),
        c("orders").alias("completed_orders"),
        c("repeat_orders").alias("completed_orders_from_repeat_customers"),
        M.pct(c("repeat_orders"), c("orders")).alias(
            "completed_order_share_from_repeat_customers_pct"
        ),
        M.avg2(c("orders"), c("people")).alias("avg_completed_orders_per_customer"),
        M.avg2(c("repeat_orders"), c("repeat")).alias("avg_completed_orders_per_repeat_customer"),
    )


def order_frequency(mk: Marketplace) -> DataFrame:
    # one row per distinct order count: a few dozen values, at most the square root of
    # twice the orders
    counts = (
        _orders_per_person(mk)
        .filter(c("completed_orders") > 0)
        .groupBy("completed_orders")
        .agg(F.count("*").alias("customer_count"))
    )
    up_to_here = Window.orderBy("completed_orders").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        "completed_orders",
        "customer_count",
        M.pct(c("customer_count"), B.total("customer_count")).alias("customer_share_pct"),
        M.pct(F.sum("customer_count").over(up_to_here), B.total("customer_count")).alias(
            "cumulative_customer_share_pct"
        ),
    ).orderBy("completed_orders")


def one_time_vs_repeat(mk: Marketplace) -> DataFrame:
    kind = F.when(c("orders") > 1, "repeat").otherwise("one_time")
    segments = (
        B.completed_values_per_person(mk)
        .groupBy(kind.alias("customer_type"))
        .agg(
            F.count("*").alias("people"),
            F.sum("orders").alias("orders"),
            F.sum("items").alias("items"),
            F.sum("sales").alias("sales"),
        )
    )
    return segments.select(
        "customer_type",
        c("people").alias("customer_count"),
        M.pct(c("people"), B.total("people")).alias("customer_share_pct"),
        c("orders").alias("completed_orders"),
        M.pct(c("orders"), B.total("orders")).alias("completed_order_share_pct"),
        c("items").alias("completed_items"),
        M.money("sales").alias("completed_item_sales_value"),
        M.pct(c("sales"), B.total("sales")).alias("item_sales_value_share_pct"),
        M.avg2(c("orders"), c("people")).alias("avg_completed_orders_per_customer"),
        M.avg2(c("items"), c("people")).alias("avg_items_per_customer"),
        M.avg_money("sales", c("people")).alias("avg_item_sales_value_per_customer"),
        M.avg_money("sales", c("orders")).alias("avg_item_sales_value_per_completed_order"),
    ).orderBy("customer_type")


def value_deciles(mk: Marketplace) -> DataFrame:
    values = B.completed_values_per_person(mk).select(c("sales").alias("v"))
    deciles = ntile_totals(values, "v", 10)
    return deciles.select(
        c("tile").alias("value_decile"),
        c("rows").alias("customer_count"),
        M.rounded(c("min_cents") / 100).alias("min_customer_item_sales_value"),
        M.rounded(M.ratio(c("sum_cents"), c("rows")) / 100).alias("avg_customer_item_sales_value"),
        M.rounded(c("max_cents") / 100).alias("max_customer_item_sales_value"),
        M.rounded(c("sum_cents") / 100).alias("total_item_sales_value"),
        M.pct(c("sum_cents"), B.total("sum_cents")).alias("item_sales_value_share_pct"),
    ).orderBy("value_decile")


def geography(mk: Marketplace) -> DataFrame:
    """Completed activity by state of the order's customer record.

    A person is repeat when they have several completed orders in any state. Persons may
    occur in more than one state, so customers are not additive.
    """
    orders = (
        B.completed_orders(mk)
        .select("order_id", "customer_id")
        .join(B.order_item_totals(mk), "order_id", "left")
        .join(
            mk.customers.select("customer_id", "customer_unique_id", "customer_state"),
            "customer_id",
        )
    )
    per_person_state = orders.groupBy("customer_unique_id", "customer_state").agg(
        F.count("*").alias("all_orders"),
        F.count("items").alias("orders"),
        F.sum("items").alias("items"),
        F.sum("sales").alias("sales"),
    )
    history = F.sum("all_orders").over(Window.partitionBy("customer_unique_id"))
    states = (
        per_person_state.withColumn("history", history)
        .filter(c("orders") > 0)
        .groupBy("customer_state")
        .agg(
            F.count("customer_unique_id").alias("people"),
            M.rows_where(c("history") > 1).alias("repeat"),
            F.sum("orders").alias("orders"),
            F.sum("items").alias("items"),
            F.sum("sales").alias("sales"),
        )
    )
    return states.select(
        "customer_state",
        c("people").alias("completed_unique_customers"),
        c("repeat").alias("completed_repeat_customers"),
        M.pct(c("repeat"), c("people")).alias("repeat_customer_rate_pct"),
        c("orders").alias("completed_orders"),
        M.pct(c("orders"), B.total("orders")).alias("completed_order_share_pct"),
        c("items").alias("completed_items"),
        M.money("sales").alias("completed_item_sales_value"),
        M.pct(c("sales"), B.total("sales")).alias("item_sales_value_share_pct"),
        M.avg_money("sales", c("orders")).alias("avg_item_sales_value_per_completed_order"),
    ).orderBy(c("completed_item_sales_value").desc(), "customer_state")
