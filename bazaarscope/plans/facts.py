"""Facts and dimensions at declared grains, and their publication as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarscope.functions import domain as D
from bazaarscope.functions import metrics as M
from bazaarscope.functions.periods import Periods
from bazaarscope.plans import base as B
from bazaarscope.sources.model import Marketplace

c = F.col
PURCHASE = "order_purchase_timestamp"


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _purchase_date() -> Column:
    return F.to_date(PURCHASE).alias("order_purchase_date")


def _order_header(mk: Marketplace) -> DataFrame:
    """What every fact takes from its order."""
    return mk.orders.select(
        "order_id",
        _purchase_date(),
        "order_status",
        _flag(M.is_completed()).alias("is_delivered"),
    )


def _days(seconds: Column) -> Column:
    return seconds / M.SECONDS_PER_DAY


# -- facts -------------------------------------------------------------------------
def fact_orders(mk: Marketplace) -> DataFrame:
    """One row per recorded order."""
    delivered, estimated = c("order_delivered_customer_date"), c("order_estimated_delivery_date")
    eligible = c("is_delivery_eligible") == 1
    delay = F.when(eligible, M.seconds_between(estimated, delivered))
    orders = (
        mk.orders.withColumn("is_delivery_eligible", _flag(M.is_delivery_eligible()))
        .join(B.order_item_totals(mk).drop("freight"), "order_id", "left")
        .join(
            B.representative_reviews(mk).withColumn("reviewed", F.lit(True)), "order_id", "left"
        )
        .join(
            mk.customers.select("customer_id", "customer_unique_id", "customer_state"),
            "customer_id",
            "left",
        )
        .withColumn("delay_s", delay)
    )
    return orders.select(
        "order_id",
        "customer_unique_id",
        "customer_state",
        "order_status",
        _purchase_date(),
        PURCHASE,
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        _flag(M.is_completed()).alias("is_delivered"),
        _flag(c("items").isNotNull()).alias("has_items"),
        F.coalesce("items", F.lit(0)).alias("item_count"),
        M.decimal_money(F.coalesce("sales", F.lit(0))).alias("item_sales_value"),
        _flag(c("reviewed")).alias("has_review"),
        c("review_score").alias("representative_review_score"),
        "is_delivery_eligible",
        F.when(eligible, _days(M.seconds_between(c(PURCHASE), delivered))).alias("delivery_days"),
        _days(c("delay_s")).alias("delivery_variance_days"),
        F.when(eligible, (c("delay_s") > 0).cast("int")).alias("is_late"),
        _days(F.when(eligible, F.greatest(c("delay_s"), F.lit(0)))).alias("late_days"),
        F.when(eligible, M.delay_band(c("delay_s")))
        .otherwise(D.DELAY_NOT_ELIGIBLE)
        .alias("delay_band"),
    )


def fact_order_categories(mk: Marketplace) -> DataFrame:
    """One row per order and category key.

    Items are first reduced to order and product, then to order and category.
    """
    per_category = (
        mk.order_items.groupBy("order_id", "product_id")
        .agg(F.count("*").alias("n"), M.cents_sum("price").alias("sales"))
        .join(B.product_categories(mk), "product_id", "left")
        .groupBy("order_id", "source_category_name")
        .agg(
            F.sum("n").alias("category_item_count"),
            F.sum("sales").alias("sales"),
        )
    )
    reviews = B.representative_reviews(mk).withColumn("reviewed", F.lit(True))
    rows = (
        per_category.join(_order_header(mk), "order_id")
        .join(reviews, "order_id", "left")
        .transform(lambda df: B.with_category_label(df, mk))
    )
    return rows.select(
        "order_id",
        "order_purchase_date",
        "order_status",
        "is_delivered",
        "source_category_name",
        c("category_name").alias("category_display_name"),
        category_key(c("source_category_name")).alias("category_key"),
        "category_item_count",
        M.decimal_money(c("sales")).alias("category_item_sales_value"),
        _flag(c("reviewed")).alias("has_review"),
        c("review_score").alias("representative_review_score"),
    )


def fact_seller_orders(mk: Marketplace) -> DataFrame:
    """One row per order and seller."""
    per_seller = mk.order_items.groupBy("order_id", "seller_id").agg(
        F.count("*").alias("seller_item_count"),
        M.cents_sum("price").alias("sales"),
    )
    return per_seller.join(_order_header(mk), "order_id").select(
        "order_id",
        "seller_id",
        "order_purchase_date",
        "order_status",
        "is_delivered",
        "seller_item_count",
        M.decimal_money(c("sales")).alias("seller_item_sales_value"),
    )


def fact_payments(mk: Marketplace) -> DataFrame:
    """One row per payment record, with counts of its order repeated on each."""
    # joined back rather than windowed: a window would hold all records of an order in
    # one task, the join can be split
    per_method = mk.payments.groupBy("order_id", "payment_type").agg(F.count("*").alias("n"))
    per_order = per_method.groupBy("order_id").agg(
        F.sum("n").alias("payment_record_count"),
        F.count("payment_type").alias("payment_method_count"),
    )
    header = mk.orders.select("order_id", _purchase_date())
    band = F.when(
        c("payment_type") == D.CARD_TYPE, M.installment_band(c("payment_installments"))
    ).otherwise(D.INSTALLMENT_NOT_APPLICABLE)
    return mk.payments.join(header.join(per_order, "order_id"), "order_id").select(
        "order_id",
        "payment_sequential",
        "order_purchase_date",
        "payment_type",
        "payment_installments",
        M.decimal_money(M.cents(c("payment_value"))).alias("payment_value"),
        "payment_record_count",
        "payment_method_count",
        _flag(c("payment_record_count") > 1).alias("is_multi_payment_order"),
        _flag(c("payment_method_count") > 1).alias("is_multi_method_order"),
        band.alias("installment_band"),
    )


# -- dimensions --------------------------------------------------------------------
def category_key(source: Column) -> Column:
    return F.coalesce(source, F.lit(D.UNKNOWN_CATEGORY_KEY))


def dim_date(mk: Marketplace, periods: Periods) -> DataFrame:
    """Every calendar day between the first and the last purchase."""
    bounds = mk.orders.agg(
        F.to_date(F.min(PURCHASE)).alias("first"), F.to_date(F.max(PURCHASE)).alias("last")
    )
    days = bounds.filter(c("first").isNotNull()).select(
        F.explode(F.sequence("first", "last")).alias("date")
    )
    at = c("date").cast("timestamp_ntz")
    matched = periods.in_matched(at)
    return days.select(
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter_number"),
        F.concat(F.lit("Q"), F.quarter("date")).alias("quarter"),
        F.month("date").alias("month_number"),
        F.date_format("date", "MMMM").alias("month"),
        F.date_format("date", "MMM").alias("month_short"),
        F.date_format("date", "yyyy-MM").alias("year_month"),
        (F.year("date") * 100 + F.month("date")).alias("year_month_sort"),
        F.trunc("date", "month").alias("month_start"),
        periods.in_core(at).cast("int").alias("is_core_analysis_period"),
        matched.cast("int").alias("is_matched_period"),
        F.when(matched, F.year("date")).alias("matched_period_year"),
    )


def dim_category(mk: Marketplace) -> DataFrame:
    sources = B.product_categories(mk).select("source_category_name").distinct()
    source, english = c("source_category_name"), c("english_category_name")
    status = (
        F.when(source.isNull(), "missing_source_category")
        .when(english.isNull(), "untranslated")
        .otherwise("translated")
    )
    return B.with_category_label(sources, mk).select(
        category_key(source).alias("category_key"),
        "source_category_name",
        F.coalesce(english, source, F.lit(D.UNKNOWN_CATEGORY_DISPLAY)).alias(
            "category_display_name"
        ),
        status.alias("translation_status"),
    )


def dim_seller(mk: Marketplace) -> DataFrame:
    return mk.sellers.select("seller_id", "seller_city", "seller_state")


def dim_customer_state(mk: Marketplace) -> DataFrame:
    """States of the customer records that orders refer to."""
    used = mk.orders.select("customer_id").distinct()
    return (
        mk.customers.join(used, "customer_id", "left_semi")
        .filter(c("customer_state").isNotNull())
        .select(c("customer_state").alias("state_code"))
        .distinct()
    )


# -- the star -----------------------------------------------------------------------
GRAINS = {
    "fact_orders": ("order_id",),
    "fact_order_categories": ("order_id", "category_key"),
    "fact_seller_orders": ("order_id", "seller_id"),
    "fact_payments": ("order_id", "payment_sequential"),
    "dim_date": ("date",),
    "dim_category": ("category_key",),
    "dim_seller": ("seller_id",),
    "dim_customer_state": ("state_code",),
}

# (fact, fact key, dimension, dimension key)
LINKS = (
    ("fact_orders", "order_purchase_date", "dim_date", "date"),
    ("fact_order_categories", "order_purchase_date", "dim_date", "date"),
    ("fact_seller_orders", "order_purchase_date", "dim_date", "date"),
    ("fact_payments", "order_purchase_date", "dim_date", "date"),
    ("fact_orders", "customer_state", "dim_customer_state", "state_code"),
    ("fact_order_categories", "category_key", "dim_category", "category_key"),
    ("fact_seller_orders", "seller_id", "dim_seller", "seller_id"),
)


class Star:
    """The facts and dimensions by name: planned from the tables, or read back."""

    def __init__(self, tables):
        self._tables = dict(tables)

    @classmethod
    def of(cls, mk: Marketplace, periods: Periods) -> Star:
        return cls(
            {
                "fact_orders": lambda: fact_orders(mk),
                "fact_order_categories": lambda: fact_order_categories(mk),
                "fact_seller_orders": lambda: fact_seller_orders(mk),
                "fact_payments": lambda: fact_payments(mk),
                "dim_date": lambda: dim_date(mk, periods),
                "dim_category": lambda: dim_category(mk),
                "dim_seller": lambda: dim_seller(mk),
                "dim_customer_state": lambda: dim_customer_state(mk),
            }
        )

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Star:
        return cls({name: spark.read.parquet(f"{folder}/{name}") for name in GRAINS})

    def __getitem__(self, name: str) -> DataFrame:
        found = self._tables[name]
        if callable(found):
            found = self._tables[name] = found()
        return found

    def publish(self, folder: str) -> None:
        """Write the star as Parquet, facts clustered by purchase date.

        The order id is part of the range key, so a day with very many orders is still
        spread over several files; readers that filter on the date skip row groups.
        """
        for name in GRAINS:
            df = self[name]
            if name.startswith("fact_"):
                keys = ("order_purchase_date", "order_id")
                df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            df.write.mode("errorifexists").parquet(f"{folder}/{name}")
