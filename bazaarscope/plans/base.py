"""Shared building blocks of the reports.

The child tables are reduced to the grain of the join before they are joined, so no
measure is multiplied and no key that owns many rows reaches a join with all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarscope.functions import metrics as M
from bazaarscope.operators.keys import latest_per_key
from bazaarscope.sources.model import Marketplace

def total(column: str) -> Column:
    """Sum over a whole result.

    Used only on grouped results with one row per status, state, category, band, month,
    decile or year; never on entities or records.
    """
    return F.sum(column).over(Window.partitionBy())


def order_item_totals(mk: Marketplace) -> DataFrame:
    """Items, sales and freight per order; money in cents."""
    return mk.order_items.groupBy("order_id").agg(
        F.count("*").alias("items"),
        M.cents_sum("price").alias("sales"),
        M.cents_sum("freight_value").alias("freight"),
    )


def completed_orders(mk: Marketplace, where: Column | None = None) -> DataFrame:
    orders = mk.orders.filter(M.is_completed())
    return orders if where is None else orders.filter(where)


def completed_items(
    mk: Marketplace, item_columns, where: Column | None = None, order_columns=()
) -> DataFrame:
    """Item rows of completed orders."""
    orders = completed_orders(mk, where).select("order_id", *order_columns)
    return mk.order_items.select("order_id", *item_columns).join(orders, "order_id")


def eligible_deliveries(mk: Marketplace) -> DataFrame:
    """Orders whose delivery can be judged, with durations in whole seconds."""
    purchase = F.col("order_purchase_timestamp")
    delivered = F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    return mk.orders.filter(M.is_delivery_eligible()).select(
        "order_id",
        "customer_id",
        "order_purchase_timestamp",
        M.seconds_between(purchase, delivered).alias("delivery_s"),
        M.seconds_between(purchase, estimated).alias("estimated_s"),
        M.seconds_between(estimated, delivered).alias("delay_s"),
        M.is_late().alias("late"),
    )


def representative_reviews(mk: Marketplace) -> DataFrame:
    """order_id and the score of its latest answered review."""
    return latest_per_key(
        mk.reviews, "order_id", ["review_answer_timestamp", "review_id"], ["review_score"]
    )


def product_categories(mk: Marketplace) -> DataFrame:
    return mk.products.select(
        "product_id", F.col("product_category_name").alias("source_category_name")
    )


def with_category_label(df: DataFrame, mk: Marketplace) -> DataFrame:
    """Add english_category_name and category_name to rows that carry a source category.

    Called on results already grouped by source category, so the lookup meets each
    category once. The source name stays beside the label: equal labels never merge.
    """
    lookup = mk.category_translation.select(
        F.col("product_category_name").alias("source_category_name"),
        F.col("product_category_name_english").alias("english_category_name"),
    )
    return df.join(lookup, "source_category_name", "left").withColumn(
        "category_name",
        M.category_label(F.col("english_category_name"), F.col("source_category_name")),
    )


def orders_per_customer_record(mk: Marketplace, *aggregates: Column) -> DataFrame:
    """Orders counted per customer record: recorded_orders, completed_orders."""
    return mk.orders.groupBy("customer_id").agg(
        F.count("*").alias("recorded_orders"),
        M.rows_where(M.is_completed()).alias("completed_orders"),
        *aggregates,
    )


def customer_people(mk: Marketplace) -> DataFrame:
    return mk.customers.select("customer_id", "customer_unique_id")


def completed_values_per_person(mk: Marketplace) -> DataFrame:
    """Persons with completed orders that have items: orders, items, sales in cents."""
    per_record = (
        completed_orders(mk)
        .select("order_id", "customer_id")
        .join(order_item_totals(mk), "order_id")
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("orders"),
            F.sum("items").alias("items"),
            F.sum("sales").alias("sales"),
        )
    )
    return (
        per_record.join(customer_people(mk), "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("items").alias("items"),
            F.sum("sales").alias("sales"),
        )
    )
