"""Seller activity: order structure, leading sellers, participation, supply geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarscope.functions import metrics as M
from bazaarscope.functions.periods import Periods
from bazaarscope.operators.members import member_counts
from bazaarscope.operators.topk import top_k_with_total
from bazaarscope.plans import base as B
from bazaarscope.sources.model import Marketplace

c = F.col
PURCHASE = "order_purchase_timestamp"
TOP_SELLERS = 20


def population(mk: Marketplace) -> DataFrame:
    per_order = mk.order_items.groupBy("order_id").agg(
        F.count_distinct("seller_id").alias("sellers")
    )
    structure = (
        B.completed_orders(mk)
        .select("order_id")
        .join(per_order, "order_id", "left")
        .agg(
            F.count("*").alias("orders"),
            F.count("sellers").alias("with_items"),
            M.rows_where(c("sellers") == 1).alias("single"),
            M.rows_where(c("sellers") > 1).alias("multi"),
            F.max("sellers").alias("most"),
            F.sum("sellers").alias("relationships"),
        )
    )
    activity = member_counts(
        B.completed_items(mk, ["product_id", "seller_id", "price"]),
        [],
        {"sellers": "seller_id", "products": "product_id"},
        {"items": F.count("*"), "sales": M.cents_sum("price")},
    )
    row = activity.select(F.struct(*activity.columns)).scalar()
    return structure.withColumn("a", row).select(
        c("orders").alias("completed_orders"),
        c("with_items").alias("completed_orders_with_items"),
        (c("orders") - c("with_items")).alias("completed_orders_without_items"),
        c("a.sellers").alias("active_sellers"),
        c("a.products").alias("products_sold"),
        c("a.items").alias("completed_items"),
        M.money("a.sales").alias("completed_item_sales_value"),
        c("single").alias("single_seller_orders"),
        c("multi").alias("multi_seller_orders"),
        M.pct(c("multi"), c("with_items")).alias("multi_seller_order_pct"),
        M.avg2(c("relationships"), c("with_items")).alias("avg_sellers_per_order"),
        c("most").alias("max_sellers_per_order"),
        c("relationships").alias("seller_order_relationships"),
    )


def top_sellers(mk: Marketplace, k: int = TOP_SELLERS) -> DataFrame:
    per_seller = member_counts(
        B.completed_items(mk, ["seller_id", "product_id", "price"]),
        ["seller_id"],
        {"completed_orders": "order_id", "products_sold": "product_id"},
        {"items_sold": F.count("*"), "sales": M.cents_sum("price")},
    )
    leading = top_k_with_total(
        per_seller, [c("sales").desc(), c("seller_id").asc()], k, "sales"
    )
    return leading.select(
        c("rank").alias("seller_rank"),
        "seller_id",
        "completed_orders",
        "items_sold",
        "products_sold",
        M.money("sales").alias("item_sales_value"),
        M.pct(c("sales"), c("grand_total")).alias("item_sales_value_share_pct"),
        M.avg_money("sales", c("items_sold")).alias("avg_item_price"),
        M.avg_money("sales", c("completed_orders")).alias("avg_seller_sales_value_per_order"),
    ).orderBy("seller_rank")


def _matched_items(mk: Marketplace, periods: Periods) -> DataFrame:
    within = periods.in_matched(c(PURCHASE))
    return B.completed_items(mk, ["seller_id", "price"], within, [PURCHASE])


def base_growth(mk: Marketplace, periods: Periods) -> DataFrame:
    per_seller = (
        _matched_items(mk, periods)
        .groupBy(F.year(PURCHASE).alias("order_year"), "seller_id")
        .agg(
            F.count_distinct("order_id").alias("orders"),
            F.count("*").alias("items"),
            M.cents_sum("price").alias("sales"),
        )
    )
    years = per_seller.groupBy("order_year").agg(
        F.count("*").alias("sellers"),
        F.sum("orders").alias("orders"),
        F.sum("items").alias("items"),
        F.sum("sales").alias("sales"),
    )
    return years.select(
        "order_year",
        c("sellers").alias("active_sellers"),
        c("orders").alias("seller_order_relationships"),
        c("items").alias("completed_items"),
        M.money("sales").alias("item_sales_value"),
        M.avg2(c("orders"), c("sellers")).alias("avg_completed_orders_per_active_seller"),
        M.avg_money("sales", c("sellers")).alias("avg_item_sales_value_per_active_seller"),
    ).orderBy("order_year")


def participation(mk: Marketplace, periods: Periods) -> DataFrame:
    """Sellers active in both matched years or in only one of them."""
    before, after = periods.years

    def sales(year: int) -> Column:
        return M.cents_sum("price", periods.in_year(c(PURCHASE), year)).alias(f"sales_{year}")

    def active(year: int) -> Column:
        return F.bool_or(periods.in_year(c(PURCHASE), year)).alias(f"active_{year}")

    per_seller = (
        _matched_items(mk, periods)
        .groupBy("seller_id")
        .agg(*[f(y) for f in (active, sales) for y in (before, after)])
    )
    was, still = c(f"active_{before}"), c(f"active_{after}")
    group = (
        F.when(was & still, "active_in_both_periods")
        .when(was, f"active_{before}_only")
        .otherwise(f"active_{after}_only")
    )
    groups = per_seller.groupBy(group.alias("participation_group")).agg(
        F.count("*").alias("sellers"),
        M.rounded(F.sum(f"sales_{before}") / 100).alias(f"item_sales_value_{before}"),
        M.rounded(F.sum(f"sales_{after}") / 100).alias(f"item_sales_value_{after}"),
    )
    label = c("participation_group")
    return groups.orderBy(
        F.when(label == "active_in_both_periods", 1)
        .when(label == f"active_{before}_only", 2)
        .otherwise(3)
    )


def geography(mk: Marketplace) -> DataFrame:
    items = B.completed_items(mk, ["seller_id", "product_id", "price"]).join(
        mk.sellers.select("seller_id", "seller_state"), "seller_id"
    )
    states = member_counts(
        items,
        ["seller_state"],
        {"sellers": "seller_id", "orders": "order_id", "products": "product_id"},
        {"items": F.count("*"), "sales": M.cents_sum("price")},
    )
    # a seller has one state, so sellers add up over the states
    return states.select(
        "seller_state",
        c("sellers").alias("active_sellers"),
        M.pct(c("sellers"), B.total("sellers")).alias("active_seller_share_pct"),
        c("orders").alias("completed_orders_with_state_seller"),
        c("items").alias("items_sold"),
        M.pct(c("items"), B.total("items")).alias("item_share_pct"),
        c("products").alias("products_sold"),
        M.money("sales").alias("item_sales_value"),
        M.pct(c("sales"), B.total("sales")).alias("item_sales_value_share_pct"),
        M.avg_money("sales", c("sellers")).alias("avg_item_sales_value_per_active_seller"),
    ).orderBy(c("item_sales_value").desc(), "seller_state")
