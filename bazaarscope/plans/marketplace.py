"""Marketplace performance: scale, trends, matched growth, status mix, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarscope.functions import metrics as M
from bazaarscope.functions.domain import UNKNOWN_CATEGORY
from bazaarscope.functions.periods import Periods
from bazaarscope.operators.members import per_member
from bazaarscope.operators.ordered import entities_for_shares
from bazaarscope.plans import base as B
from bazaarscope.sources.model import Marketplace

c = F.col
PURCHASE = "order_purchase_timestamp"


def scale(mk: Marketplace) -> DataFrame:
    """Recorded against completed orders, customers, items, products, sellers and sales."""
    per_person = (
        B.orders_per_customer_record(mk)
        .join(B.customer_people(mk), "customer_id", "left")
        .groupBy("customer_unique_id")
        .agg(
            F.sum("recorded_orders").alias("recorded"),
            F.sum("completed_orders").alias("completed"),
        )
    )
    person = c("customer_unique_id").isNotNull()
    orders = per_person.agg(
        F.coalesce(F.sum("recorded"), F.lit(0)).alias("recorded_orders"),
        F.coalesce(F.sum("completed"), F.lit(0)).alias("completed_orders"),
        M.rows_where(person).alias("recorded_unique_customers"),
        M.rows_where(person & (c("completed") > 0)).alias("completed_unique_customers"),
    )
    done = M.is_completed()
    # every product and every seller with its activity: distinct counts become row counts
    entities = per_member(
        mk.order_items.join(mk.orders.select("order_id", "order_status"), "order_id"),
        [],
        ["product_id", "seller_id"],
        {
            "n": F.count("*"),
            "n_done": M.rows_where(done),
            "sales": M.cents_sum("price"),
            "sales_done": M.cents_sum("price", done),
            "freight": M.cents_sum("freight_value"),
            "freight_done": M.cents_sum("freight_value", done),
        },
    )
    active = c("n_done") > 0
    product = (c("_member") == "product_id") & c("product_id").isNotNull()
    seller = (c("_member") == "seller_id") & c("seller_id").isNotNull()

    def total(name: str) -> Column:
        # products and sellers each hold all items; add up one of them
        return F.sum(F.when(c("_member") == "product_id", c(name)))

    items = entities.agg(
        F.coalesce(total("n"), F.lit(0)).alias("recorded_items"),
        F.coalesce(total("n_done"), F.lit(0)).alias("completed_items"),
        M.rows_where(product).alias("recorded_products"),
        M.rows_where(product & active).alias("completed_products"),
        M.rows_where(seller).alias("recorded_sellers"),
        M.rows_where(seller & active).alias("completed_sellers"),
        *[total(n).alias(n) for n in ("sales", "sales_done", "freight", "freight_done")],
    )
    item_row = items.select(F.struct(*items.columns)).scalar()
    row = orders.withColumn("i", item_row)
    return row.select(
        "recorded_orders",
        "completed_orders",
        M.pct(c("completed_orders"), c("recorded_orders")).alias("completed_order_rate_pct"),
        "recorded_unique_customers",
        "completed_unique_customers",
        *[
            c(f"i.{name}").alias(name)
            for name in (
                "recorded_items",
                "completed_items",
                "recorded_products",
                "completed_products",
                "recorded_sellers",
                "completed_sellers",
            )
        ],
        M.money("i.sales").alias("recorded_item_sales_value"),
        M.money("i.sales_done").alias("completed_item_sales_value"),
        M.money("i.freight").alias("recorded_freight_value"),
        M.money("i.freight_done").alias("completed_freight_value"),
        M.avg2(c("i.completed_items"), c("completed_orders")).alias(
            "avg_items_per_completed_order"
        ),
        M.avg_money("i.sales_done", c("completed_orders")).alias(
            "avg_item_sales_value_per_completed_order"
        ),
    )


def _activity(mk: Marketplace, within: Column, label: str, group: Column) -> DataFrame:
    """Orders, customers, items and sales per purchase-time group, in one pass.

    Items are reduced to orders, orders to (group, person), and only then to the group, so
    distinct customers need no distinct aggregate.
    """
    done = M.is_completed()
    orders = (
        mk.orders.filter(within)
        .select("order_id", "customer_id", group.alias(label), done.alias("done"))
        .join(B.order_item_totals(mk).drop("freight"), "order_id", "left")
        .join(B.customer_people(mk), "customer_id", "left")
    )
    per_person = orders.groupBy(label, "customer_unique_id").agg(
        F.count("*").alias("orders"),
        M.rows_where(c("done")).alias("orders_done"),
        F.sum("items").alias("items"),
        M.sum_where(c("done"), c("items")).alias("items_done"),
        M.sum_where(c("done"), c("sales")).alias("sales_done"),
    )
    person = c("customer_unique_id").isNotNull()
    grouped = per_person.groupBy(label).agg(
        F.sum("orders").alias("recorded_orders"),
        F.sum("orders_done").alias("completed_orders"),
        M.rows_where(person).alias("recorded_unique_customers"),
        M.rows_where(person & (c("orders_done") > 0)).alias("completed_unique_customers"),
        F.sum("items").alias("recorded_items"),
        F.sum("items_done").alias("completed_items"),
        F.sum("sales_done").alias("sales"),
    )
    # groups without any item or any known customer are not reported
    return grouped.filter((c("recorded_items") > 0) & (c("recorded_unique_customers") > 0))


def _activity_report(activity: DataFrame, label: str) -> DataFrame:
    return activity.select(
        label,
        "recorded_orders",
        "completed_orders",
        M.pct(c("completed_orders"), c("recorded_orders")).alias("completed_order_rate_pct"),
        "recorded_unique_customers",
        "completed_unique_customers",
        "recorded_items",
        "completed_items",
        M.money("sales").alias("completed_item_sales_value"),
        M.avg_money("sales", c("completed_orders")).alias(
            "avg_item_sales_value_per_completed_order"
        ),
    ).orderBy(label)


def monthly_trends(mk: Marketplace, periods: Periods) -> DataFrame:
    within = periods.in_core(c(PURCHASE))
    return _activity_report(
        _activity(mk, within, "order_month", M.month(c(PURCHASE))), "order_month"
    )


def _matched_activity(mk: Marketplace, periods: Periods) -> DataFrame:
    return _activity(mk, periods.in_matched(c(PURCHASE)), "order_year", F.year(PURCHASE))


def matched_period_metrics(mk: Marketplace, periods: Periods) -> DataFrame:
    return _activity_report(_matched_activity(mk, periods), "order_year")


def matched_period_growth(mk: Marketplace, periods: Periods) -> DataFrame:
    """Percentage change of five metrics against the previous matched year."""
    metrics = {
        "completed_order_growth_pct": c("completed_orders"),
        "completed_customer_growth_pct": c("completed_unique_customers"),
        "completed_item_growth_pct": c("completed_items"),
        "completed_item_sales_value_growth_pct": c("sales"),
        "avg_item_sales_value_per_order_growth_pct": M.ratio(c("sales"), c("completed_orders")),
    }
    by_year = Window.orderBy("order_year")  # one row per matched year
    lagged = _matched_activity(mk, periods).select(
        "order_year",
        F.lag("completed_orders").over(by_year).alias("previous_orders"),
        *[
            M.growth_pct(value, F.lag(value).over(by_year)).alias(name)
            for name, value in metrics.items()
        ],
    )
    return (
        lagged.filter(c("previous_orders").isNotNull())
        .select("order_year", *metrics)
        .orderBy("order_year")
    )


def status_mix(mk: Marketplace, periods: Periods) -> DataFrame:
    counts = (
        mk.orders.filter(periods.in_matched(c(PURCHASE)))
        .groupBy(F.year(PURCHASE).alias("order_year"), "order_status")
        .agg(F.count("*").alias("order_count"))
    )
    year_total = F.sum("order_count").over(Window.partitionBy("order_year"))
    return counts.select(
        "order_year",
        "order_status",
        "order_count",
        M.pct(c("order_count"), year_total).alias("status_share_pct"),
    ).orderBy("order_year", c("order_count").desc(), "order_status")


def merchandise_by_status(mk: Marketplace) -> DataFrame:
    by_status = (
        mk.orders.select("order_id", "order_status")
        .join(B.order_item_totals(mk), "order_id", "left")
        .groupBy("order_status")
        .agg(
            F.count("*").alias("recorded_orders"),
            F.count("items").alias("orders_with_items"),
            F.coalesce(F.sum("items"), F.lit(0)).alias("item_count"),
            F.coalesce(F.sum("sales"), F.lit(0)).alias("sales"),
            F.coalesce(F.sum("freight"), F.lit(0)).alias("freight"),
        )
    )
    return by_status.select(
        "order_status",
        "recorded_orders",
        "orders_with_items",
        "item_count",
        M.money("sales").alias("item_sales_value"),
        M.pct(c("sales"), B.total("sales")).alias("item_sales_value_share_pct"),
        M.money("freight").alias("freight_value"),
    ).orderBy(c("item_sales_value").desc())


def concentration(mk: Marketplace) -> DataFrame:
    """Entities that make up 50% and 80% of completed sales: customer, category, seller.

    The items are read and joined once; grouping sets then total them per person, category
    and seller together.
    """
    members = {"customer_unique_id": "customer", "category": "category", "seller_id": "seller"}
    people = (
        B.completed_orders(mk)
        .select("order_id", "customer_id")
        .join(B.customer_people(mk), "customer_id", "left")
    )
    category = F.coalesce("source_category_name", F.lit(UNKNOWN_CATEGORY))
    products = B.product_categories(mk).select("product_id", category.alias("category"))
    items = (
        mk.order_items.select("order_id", "product_id", "seller_id", "price")
        .join(people, "order_id")
        .join(products, "product_id", "left")
    )
    sold = per_member(items, [], list(members), {"v": M.cents_sum("price")})
    label, known = F.lit(None).cast("string"), F.lit(False)
    for column, name in members.items():
        own = c("_member") == column
        label = F.when(own, name).otherwise(label)
        known = known | (own & c(column).isNotNull())
    entities = sold.filter(known).select(label.alias("entity_type"), "v")
    shares = {"entities_for_50_pct": 50, "entities_for_80_pct": 80}
    reached = entities_for_shares(entities, "v", shares, by=["entity_type"])
    return reached.select(
        "entity_type",
        c("entities").alias("total_entities"),
        "entities_for_50_pct",
        M.pct(c("entities_for_50_pct"), c("entities")).alias("entity_share_for_50_pct"),
        "entities_for_80_pct",
        M.pct(c("entities_for_80_pct"), c("entities")).alias("entity_share_for_80_pct"),
    ).orderBy("entity_type")
