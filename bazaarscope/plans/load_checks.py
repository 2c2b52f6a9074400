"""Checks of the loaded tables against expected values, section by section.

Every section returns section, metric, actual_value; ``judged`` compares them with
expected values that are passed in as data.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarscope.functions import domain as D
from bazaarscope.functions import metrics as M
from bazaarscope.operators.keys import duplicate_profile
from bazaarscope.operators.profile import long_aggregate, union_all
from bazaarscope.plans import audit as A
from bazaarscope.sources import versions
from bazaarscope.sources.model import Marketplace

c = F.col
VALUE = "decimal(18,2)"


def _section(rows: DataFrame, section: str, metric: Column, value: Column) -> DataFrame:
    return rows.select(
        F.lit(section).alias("section"),
        metric.alias("metric"),
        value.cast(VALUE).alias("actual_value"),
    )


def _metrics(rows: DataFrame, section: str, metrics: Mapping[str, Column]) -> DataFrame:
    entries = [({"metric": F.lit(k)}, {"value": v.cast(VALUE)}) for k, v in metrics.items()]
    return _section(long_aggregate(rows, entries), section, c("metric"), c("value"))


def row_counts(mk: Marketplace) -> DataFrame:
    return _section(A.inventory(mk), "rows", c("table_name"), c("rows"))


def keys(mk: Marketplace) -> DataFrame:
    """Rows that a repeated or incomplete key would cost; 0 is expected."""
    profile = A.key_checks(mk)
    metric = F.concat(c("table_name"), F.lit(".("), c("key_columns"), F.lit(")"))
    lost = c("total_rows") - c("unique_combinations") + c("missing_key_rows")
    return _section(profile, "keys", metric, lost)


def foreign_keys(mk: Marketplace) -> DataFrame:
    return _section(
        A.relationship_orphans(mk), "foreign_keys", c("relationship"), c("orphan_rows"))


def coverage(mk: Marketplace) -> DataFrame:
    return _section(A.parent_coverage(mk), "coverage", c("relationship"), c("childless_rows"))


def cardinality(mk: Marketplace) -> DataFrame:
    """Distinct persons, largest groups, and rows of repeated review ids."""

    def largest(table: str, column: str, metric: str) -> DataFrame:
        sizes = mk[table].groupBy(column).agg(F.count("*").alias("n"))
        return _section(sizes.agg(F.max("n").alias("n")), "cardinality", F.lit(metric), c("n"))

    people = mk.customers.groupBy("customer_unique_id").agg(F.count("*").alias("n"))
    repeated = A.repeated_ids(mk).filter(c("identifier") == "review_id")
    return union_all([
        _metrics(people, "cardinality", {
            "distinct_customer_unique_id": F.count("customer_unique_id"),
            "max_customer_records_per_unique_customer": F.max("n"),
        }),
        largest("order_items", "order_id", "max_items_per_order"),
        largest("payments", "order_id", "max_payments_per_order"),
        largest("reviews", "order_id", "max_reviews_per_order"),
        _section(repeated, "cardinality", F.lit("rows_with_repeated_review_id"),
                 c("repeated_rows")),
    ])


def nulls(mk: Marketplace) -> DataFrame:
    parts = [
        _metrics(mk[table], "nulls", {
            f"{table}.{name}": M.rows_where(c(name).isNull()) for name in names
        })
        for table, names in D.NULLABLE_COLUMNS.items()
    ]
    return union_all(parts)


def numeric_ranges(mk: Marketplace) -> DataFrame:
    columns = {
        "order_items": ("price", "freight_value"),
        "payments": ("payment_value",),
        "reviews": ("review_score",),
        "products": ("product_weight_g",),
    }
    parts = []
    for table, names in columns.items():
        metrics = {}
        for name in names:
            metrics[f"{table}.{name} minimum"] = F.min(name)
            metrics[f"{table}.{name} maximum"] = F.max(name)
        parts.append(_metrics(mk[table], "numeric_ranges", metrics))
    return union_all(parts)


def unusual_values(mk: Marketplace) -> DataFrame:
    return union_all([
        _metrics(mk.payments, "unusual_values", {
            "zero_payment_values": M.rows_where(c("payment_value") == 0),
            "zero_payment_installments": M.rows_where(c("payment_installments") == 0),
            "not_defined_payment_type": M.rows_where(c("payment_type") == "not_defined"),
        }),
        _metrics(mk.products, "unusual_values", {
            "zero_product_weight": M.rows_where(c("product_weight_g") == 0),
        }),
    ])


def temporal_anomalies(mk: Marketplace, shipping_limit_from: str) -> DataFrame:
    names = {
        "order_delivered_carrier_date < order_purchase_timestamp": "carrier_before_purchase",
        "order_delivered_customer_date < order_delivered_carrier_date": "customer_delivery_before_carrier",
        "review_creation_date < purchase day": "review_creation_before_purchase_date",
        "shipping_limit_date beyond the period": "shipping_limit_after_data_period",
    }
    label = F.lit(None).cast("string")
    for check, name in names.items():
        label = F.when(c("check") == check, name).otherwise(label)
    rows = union_all([
        A.order_timeline(mk), A.review_timeline(mk), A.shipping_limits(mk, shipping_limit_from),
    ]).filter(c("check").isin(*names))
    return _section(rows, "temporal_anomalies", label, c("affected_rows"))


def categories(mk: Marketplace) -> DataFrame:
    gaps = A.untranslated_categories(mk)
    return union_all([
        _metrics(mk.products, "categories", {
            "distinct_product_categories": F.count_distinct("product_category_name"),
        }),
        _metrics(mk.category_translation, "categories", {
            "translation_lookup_categories": F.count("*"),
        }),
        _metrics(gaps, "categories", {
            "untranslated_categories": F.count("*"),
            "products_in_untranslated_categories": F.coalesce(F.sum("products"), F.lit(0)),
        }),
    ])


def geolocation(mk: Marketplace, stored: DataFrame) -> DataFrame:
    """Density of the places, and the ids as the load has ``stored`` them beside the places."""
    ids = versions.id_checks(stored)
    density = A.geolocation_density(mk)
    excess = duplicate_profile(mk.geolocation)
    return union_all([
        _section(density, "geolocation", F.lit("geolocation_rows"), c("geolocation_rows")),
        _section(ids, "geolocation", F.lit("unique_geolocation_ids"), c("distinct_ids")),
        _section(ids, "geolocation", F.lit("largest_geolocation_id"), c("largest_id")),
        _section(ids, "geolocation", F.lit("geolocation_rows_without_id"), c("rows_without_id")),
        _section(ids, "geolocation", F.lit("geolocation_rows_sharing_an_id"), c("rows_sharing_an_id")),
        _section(density, "geolocation", F.lit("distinct_geolocation_zip_prefixes"),
                 c("distinct_zip_prefixes")),
        _section(density, "geolocation", F.lit("maximum_rows_per_zip_prefix"),
                 c("maximum_rows_per_zip_prefix")),
        _section(excess, "geolocation", F.lit("exact_duplicate_geolocation_rows"),
                 c("excess_duplicate_rows")),
    ])


# -- fixed values: published counts of the original data set ------------------------------
PUBLISHED = {
    "rows": {
        "customers": 99441, "products": 32951, "sellers": 3095, "category_translation": 71,
        "geolocation": 738332, "orders": 99441, "order_items": 112650, "payments": 103886,
        "reviews": 99224,
    },
    "coverage": {
        "customers_without_orders": 0, "orders_without_items": 775,
        "orders_without_payments": 1, "orders_without_reviews": 768,
        "products_without_sales": 0, "sellers_without_sales": 0,
    },
    "cardinality": {
        "distinct_customer_unique_id": 96096, "max_customer_records_per_unique_customer": 17,
        "max_items_per_order": 21, "max_payments_per_order": 29, "max_reviews_per_order": 3,
        "rows_with_repeated_review_id": 1603,
    },
    "nulls": {
        "orders.order_approved_at": 160, "orders.order_delivered_carrier_date": 1783,
        "orders.order_delivered_customer_date": 2965, "reviews.review_comment_title": 87658,
        "reviews.review_comment_message": 58274, "products.product_category_name": 610,
        "products.product_name_length": 610, "products.product_description_length": 610,
        "products.product_photos_qty": 610, "products.product_weight_g": 2,
        "products.product_length_cm": 2, "products.product_height_cm": 2,
        "products.product_width_cm": 2,
    },
    "numeric_ranges": {
        "order_items.price minimum": "0.85", "order_items.price maximum": "6735.00",
        "order_items.freight_value minimum": "0.00", "order_items.freight_value maximum": "409.68",
        "payments.payment_value minimum": "0.00", "payments.payment_value maximum": "13664.08",
        "reviews.review_score minimum": 1, "reviews.review_score maximum": 5,
        "products.product_weight_g minimum": 0, "products.product_weight_g maximum": 40425,
    },
    "unusual_values": {
        "zero_payment_values": 9, "zero_payment_installments": 2,
        "not_defined_payment_type": 3, "zero_product_weight": 4,
    },
    "temporal_anomalies": {
        "carrier_before_purchase": 166, "customer_delivery_before_carrier": 23,
        "review_creation_before_purchase_date": 64, "shipping_limit_after_data_period": 4,
    },
    "categories": {
        "distinct_product_categories": 73, "translation_lookup_categories": 71,
        "untranslated_categories": 2, "products_in_untranslated_categories": 13,
    },
    "geolocation": {
        "geolocation_rows": 738332, "unique_geolocation_ids": 738332,
        "largest_geolocation_id": 738332, "distinct_geolocation_zip_prefixes": 19015,
        "maximum_rows_per_zip_prefix": 779, "exact_duplicate_geolocation_rows": 0,
        "geolocation_rows_without_id": 0, "geolocation_rows_sharing_an_id": 0,
    },
}


def judged(rows: DataFrame, expected: Mapping[str, object] | None = None) -> DataFrame:
    """Add expected_value and PASS or FAIL. Without expectations a metric must be 0."""
    if expected is None:
        want = F.lit(0).cast(VALUE)
    else:
        want = F.lit(None).cast(VALUE)
        for metric, value in expected.items():
            want = F.when(c("metric") == metric, F.lit(str(value)).cast(VALUE)).otherwise(want)
    equal = F.coalesce(c("actual_value") == c("expected_value"), F.lit(False))
    return (
        rows.withColumn("expected_value", want)
        .withColumn("status", F.when(equal, "PASS").otherwise("FAIL"))
        .select("section", "metric", "expected_value", "actual_value", "status")
    )


def all_sections(
    mk: Marketplace, expected: Mapping[str, Mapping[str, object]], shipping_limit_from: str
) -> DataFrame:
    """Every section judged against its expected values."""
    sections = {
        "rows": row_counts(mk),
        "keys": keys(mk),
        "foreign_keys": foreign_keys(mk),
        "coverage": coverage(mk),
        "cardinality": cardinality(mk),
        "nulls": nulls(mk),
        "numeric_ranges": numeric_ranges(mk),
        "unusual_values": unusual_values(mk),
        "temporal_anomalies": temporal_anomalies(mk, shipping_limit_from),
        "categories": categories(mk),
        "geolocation": geolocation(mk),
    }
    return union_all([judged(rows, expected.get(name)) for name, rows in sections.items()])
