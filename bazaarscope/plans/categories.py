"""Category and product performance, growth, concentration and review outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarscope.functions import metrics as M
from bazaarscope.functions.periods import Periods
from bazaarscope.operators.members import member_counts
from bazaarscope.operators.ordered import entities_for_shares
from bazaarscope.operators.topk import top_k_with_total
from bazaarscope.plans import base as B
from bazaarscope.plans.delivery import review_outcome_columns, review_outcome_sums
from bazaarscope.sources.model import Marketplace

c = F.col
PURCHASE = "order_purchase_timestamp"
TOP_PRODUCTS = 20


def population(mk: Marketplace) -> DataFrame:
    """Completed items with and without a category, and with an untranslated one."""
    per_product = (
        B.completed_items(mk, ["product_id", "price"])
        .groupBy("product_id")
        .agg(F.count("*").alias("items"), M.cents_sum("price").alias("sales"))
    )
    per_source = (
        per_product.join(B.product_categories(mk), "product_id")
        .groupBy("source_category_name")
        .agg(
            F.count("*").alias("products"),
            F.sum("items").alias("items"),
            F.sum("sales").alias("sales"),
        )
    )
    source, english = c("source_category_name"), c("english_category_name")
    missing = source.isNull()
    untranslated = source.isNotNull() & english.isNull()
    row = B.with_category_label(per_source, mk).agg(
        F.sum("items").alias("items"),
        F.sum("products").alias("products"),
        F.sum("sales").alias("sales"),
        M.sum_where(missing, c("items")).alias("missing_items"),
        M.sum_where(missing, c("sales")).alias("missing_sales"),
        M.sum_where(untranslated, c("items")).alias("untranslated_items"),
        M.sum_where(untranslated, c("sales")).alias("untranslated_sales"),
        F.count(source).alias("sources"),
        F.count_distinct(english).alias("translated"),
    )
    return row.select(
        c("items").alias("completed_items"),
        c("products").alias("completed_products"),
        M.money("sales").alias("completed_item_sales_value"),
        c("missing_items").alias("items_missing_category"),
        M.pct(c("missing_items"), c("items")).alias("items_missing_category_pct"),
        M.money("missing_sales").alias("sales_value_missing_category"),
        c("untranslated_items").alias("items_with_untranslated_category"),
        M.money("untranslated_sales").alias("sales_value_untranslated_category"),
        c("sources").alias("represented_source_categories"),
        c("translated").alias("represented_translated_categories"),
    )


def _categorised_items(
    mk: Marketplace, item_columns, where: Column | None = None, order_columns=()
) -> DataFrame:
    items = B.completed_items(mk, ["product_id", *item_columns], where, order_columns)
    return items.join(B.product_categories(mk), "product_id")


def performance(mk: Marketplace) -> DataFrame:
    per_source = member_counts(
        _categorised_items(mk, ["price"]),
        ["source_category_name"],
        {"completed_orders": "order_id", "products_sold": "product_id"},
        {"items_sold": F.count("*"), "sales": M.cents_sum("price")},
    )
    return B.with_category_label(per_source, mk).select(
        "category_name",
        "completed_orders",
        "items_sold",
        "products_sold",
        M.money("sales").alias("item_sales_value"),
        M.pct(c("sales"), B.total("sales")).alias("item_sales_value_share_pct"),
        M.pct(c("items_sold"), B.total("items_sold")).alias("item_share_pct"),
        M.avg_money("sales", c("items_sold")).alias("avg_item_price"),
        M.avg_money("sales", c("completed_orders")).alias("avg_category_sales_value_per_order"),
    ).orderBy(c("item_sales_value").desc(), "category_name")


def growth(mk: Marketplace, periods: Periods) -> DataFrame:
    """Category sales of two matched years: change, growth, share and contribution."""
    before, after = periods.years
    within = periods.in_matched(c(PURCHASE))
    per_year = (
        _categorised_items(mk, ["price"], within, [PURCHASE])
        .groupBy("source_category_name", F.year(PURCHASE).alias("order_year"))
        .agg(
            F.count("*").alias("items"),
            F.count_distinct("order_id").alias("orders"),
            M.cents_sum("price").alias("sales"),
        )
    )

    def of(year: int, measure: str) -> Column:
        return M.sum_where(c("order_year") == year, c(measure)).alias(f"{measure}_{year}")

    compared = per_year.groupBy("source_category_name").agg(
        *[of(y, m) for m in ("orders", "items", "sales") for y in (before, after)]
    )
    old, new = c(f"sales_{before}"), c(f"sales_{after}")
    all_old, all_new = B.total(f"sales_{before}"), B.total(f"sales_{after}")
    share_gap = M.raw_pct(new, all_new) - M.raw_pct(old, all_old)
    return B.with_category_label(compared, mk).select(
        "category_name",
        c(f"orders_{before}").alias(f"completed_orders_{before}"),
        c(f"orders_{after}").alias(f"completed_orders_{after}"),
        c(f"items_{before}").alias(f"items_sold_{before}"),
        c(f"items_{after}").alias(f"items_sold_{after}"),
        M.rounded(old / 100).alias(f"item_sales_value_{before}"),
        M.rounded(new / 100).alias(f"item_sales_value_{after}"),
        M.rounded((new - old) / 100).alias("item_sales_value_change"),
        M.pct(new - old, old).alias("item_sales_value_growth_pct"),
        M.pct(old, all_old).alias(f"marketplace_share_{before}_pct"),
        M.pct(new, all_new).alias(f"marketplace_share_{after}_pct"),
        M.rounded(share_gap).alias("marketplace_share_change_pp"),
        M.pct(new - old, all_new - all_old).alias("contribution_to_sales_growth_pct"),
    ).orderBy(c("item_sales_value_change").desc(), "category_name")


def product_concentration(mk: Marketplace) -> DataFrame:
    values = (
        B.completed_items(mk, ["product_id", "price"])
        .groupBy("product_id")
        .agg(M.cents_sum("price").alias("v"))
        .select("v")
    )
    reached = entities_for_shares(values, "v", {"half": 50, "most": 80})
    return reached.select(
        c("entities").alias("completed_products"),
        c("half").alias("products_for_50_pct_sales"),
        M.pct(c("half"), c("entities")).alias("product_share_for_50_pct_sales"),
        c("most").alias("products_for_80_pct_sales"),
        M.pct(c("most"), c("entities")).alias("product_share_for_80_pct_sales"),
    )


def top_products(mk: Marketplace, k: int = TOP_PRODUCTS) -> DataFrame:
    per_product = (
        B.completed_items(mk, ["product_id", "price"])
        .groupBy("product_id")
        .agg(
            F.count_distinct("order_id").alias("completed_orders"),
            F.count("*").alias("items_sold"),
            M.cents_sum("price").alias("sales"),
        )
        .join(B.product_categories(mk), "product_id")
    )
    leading = top_k_with_total(
        per_product, [c("sales").desc(), c("product_id").asc()], k, "sales"
    )
    return B.with_category_label(leading, mk).select(
        c("rank").alias("product_rank"),
        "product_id",
        "category_name",
        "completed_orders",
        "items_sold",
        M.money("sales").alias("item_sales_value"),
        M.pct(c("sales"), c("grand_total")).alias("item_sales_value_share_pct"),
        M.avg_money("sales", c("items_sold")).alias("avg_item_price"),
    ).orderBy("product_rank")


def review_outcomes(mk: Marketplace) -> DataFrame:
    """Representative reviews of all orders that contain a category, once per category."""
    order_categories = (
        mk.order_items.select("order_id", "product_id")
        .join(B.product_categories(mk), "product_id")
        .select("order_id", "source_category_name")
        .distinct()
    )
    reviews = B.representative_reviews(mk).withColumn("reviewed", F.lit(True))
    per_source = (
        order_categories.join(reviews, "order_id", "left")
        .groupBy("source_category_name")
        .agg(*review_outcome_sums())
    )
    return B.with_category_label(per_source, mk).select(
        "category_name",
        c("n").alias("orders_with_category"),
        c("n_reviewed").alias("reviewed_orders"),
        *review_outcome_columns(),
    ).orderBy(c("reviewed_orders").desc(), "category_name")
