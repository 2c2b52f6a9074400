"""Grain, key, coverage and total checks of the published star."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarscope.functions import metrics as M
from bazaarscope.operators.profile import union_all
from bazaarscope.operators.tally import Key, Source, Tally
from bazaarscope.plans.facts import GRAINS, LINKS, Star
from bazaarscope.plans.reconcile import with_status

c = F.col


_INCOMPLETE = "key holds NULL"


def _grain_topic(name: str) -> str:
    return f"grain of {name}"


def _link_label(fact: str, fact_key: str, dimension: str, dimension_key: str) -> str:
    return f"{fact}.{fact_key} -> {dimension}.{dimension_key}"


def _sources(star: Star, grains: bool, links: bool) -> list[Source]:
    """Every table once, with its own key and the keys of all its links."""
    found = []
    for name, columns in GRAINS.items():
        keys, rules = [], []
        if grains:
            incomplete = F.greatest(*[c(k).isNull() for k in columns], F.lit(False))
            rules.append((_INCOMPLETE, incomplete))
            keys.append(Key(_grain_topic(name), [c(k) for k in columns]))
        for link in LINKS if links else ():
            fact, fact_key, dimension, dimension_key = link
            if name == dimension:
                keys.append(Key(_link_label(*link), [c(dimension_key)], 0, skip_null=True))
            elif name == fact:
                keys.append(Key(_link_label(*link), [c(fact_key)], 1, skip_null=True))
        found.append(Source(name, star[name], rules, keys, few=True))
    return found


def _tallied(star: Star, grains: bool, links: bool) -> DataFrame:
    """One row with a map from ``topic/item`` to its counts; it has an entry or two for each key."""
    summary = Tally(_sources(star, grains, links)).summary()
    counts = F.struct("rows_0", "distinct_0", "orphan_rows_1")
    entry = F.struct(F.concat_ws("/", "topic", "item"), counts)
    return summary.agg(F.map_from_entries(F.collect_list(entry)).alias("found"))


def _count(topic: str, item: str, statistic: str) -> Column:
    """A table without rows has no entries, so all its counts are 0."""
    return F.coalesce(c("found")[f"{topic}/{item}"][statistic], F.lit(0).cast("bigint"))


def _grain_rows(tallied: DataFrame) -> DataFrame:
    rows = [
        F.struct(
            F.lit(name).alias("dataset"),
            F.lit(" + ".join(keys)).alias("key_columns"),
            _count(name, "*", "rows_0").alias("total_rows"),
            _count(_grain_topic(name), "", "distinct_0").alias("unique_combinations"),
            _count(name, _INCOMPLETE, "rows_0").alias("missing_key_rows"),
        )
        for name, keys in GRAINS.items()
    ]
    valid = (c("total_rows") == c("unique_combinations")) & (c("missing_key_rows") == 0)
    return tallied.select(F.inline(F.array(*rows))).withColumn(
        "status", F.when(valid, "PASS").otherwise("FAIL")
    )


def _link_rows(tallied: DataFrame) -> DataFrame:
    rows = [
        F.struct(
            F.lit(_link_label(*link)).alias("link"),
            _count(_link_label(*link), "", "orphan_rows_1").alias("orphan_rows"),
        )
        for link in LINKS
    ]
    return tallied.select(F.inline(F.array(*rows))).withColumn(
        "status", F.when(c("orphan_rows") == 0, "PASS").otherwise("FAIL")
    )


def grain_checks(star: Star) -> DataFrame:
    """Every fact and dimension: rows, distinct keys, rows with an incomplete key.

    Each table is read once, and all keys meet in one shuffle.
    """
    return _grain_rows(_tallied(star, grains=True, links=False))


def link_checks(star: Star) -> DataFrame:
    """Fact rows without their dimension member, for the seven links; each table is read once.

    Equal keys of a fact meet on the map side, so the shuffle holds distinct keys only.
    """
    return _link_rows(_tallied(star, grains=False, links=True))


def integrity(star: Star) -> DataFrame:
    """Grains and links from the same single pass: ``check, subject, faults, status``.

    Faults of a grain are rows beyond the first of their key and rows with an incomplete one.
    """
    tallied = _tallied(star, grains=True, links=True)
    grain = [
        F.struct(
            F.lit("grain").alias("check"),
            F.lit(f"{name} ({', '.join(keys)})").alias("subject"),
            (
                _count(name, "*", "rows_0")
                - _count(_grain_topic(name), "", "distinct_0")
                + _count(name, _INCOMPLETE, "rows_0")
            ).alias("faults"),
        )
        for name, keys in GRAINS.items()
    ]
    link = [
        F.struct(
            F.lit("link").alias("check"),
            F.lit(_link_label(*x)).alias("subject"),
            _count(_link_label(*x), "", "orphan_rows_1").alias("faults"),
        )
        for x in LINKS
    ]
    return tallied.select(F.inline(F.array(*grain, *link))).withColumn(
        "status", F.when(c("faults") == 0, "PASS").otherwise("FAIL")
    )


def calendar_check(star: Star) -> DataFrame:
    """The calendar is unique, complete and without gaps."""
    row = star["dim_date"].agg(
        F.count("*").alias("days"),
        F.count_distinct("date").alias("distinct_days"),
        (F.datediff(F.max("date"), F.min("date")) + 1).cast("bigint").alias("span_days"),
    )
    ok = (c("days") == c("distinct_days")) & (c("days") == c("span_days"))
    return row.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def cross_fact_check(star: Star) -> DataFrame:
    """Items and their sales by purchase month and delivery, in the three facts that hold them.

    The facts are built along different paths, so this needs no expected values. Each fact is
    read once and reduced to one row per month before the facts meet.
    """
    sources = {
        "order": ("fact_orders", "item_count", "item_sales_value"),
        "category": ("fact_order_categories", "category_item_count", "category_item_sales_value"),
        "seller": ("fact_seller_orders", "seller_item_count", "seller_item_sales_value"),
    }
    parts = []
    for name, (fact, items, sales) in sources.items():
        month = F.date_format("order_purchase_date", "yyyy-MM").alias("purchase_month")
        part = star[fact].groupBy(month, "is_delivered").agg(
            F.sum(items).alias("items"), F.sum(sales).alias("sales")
        )
        # an order without items is a month's row of the order fact only
        parts.append(part.filter(c("items") > 0).withColumn("fact", F.lit(name)))
    rows = union_all(parts).groupBy("purchase_month", "is_delivered").agg(
        *[
            F.coalesce(F.sum(F.when(c("fact") == name, c(value))), F.lit(0)).alias(f"{name}_{value}")
            for value in ("items", "sales")
            for name in sources
        ]
    )
    same = F.lit(True)
    for value in ("items", "sales"):
        for name in ("category", "seller"):
            same = same & (c(f"order_{value}") == c(f"{name}_{value}"))
    return rows.withColumn("status", F.when(same, "PASS").otherwise("FAIL"))


# -- totals against expected values ------------------------------------------------
def _fact_aggregates() -> dict[str, dict[str, Column]]:
    delivered = c("is_delivered") == 1
    eligible = c("is_delivery_eligible") == 1
    return {
        "fact_orders": {
            "rows": F.count("*"),
            "delivered_orders": F.sum("is_delivered"),
            "orders_without_items": M.rows_where(c("has_items") == 0),
            "recorded_item_count": F.sum("item_count"),
            "delivered_item_count": M.sum_where(delivered, c("item_count")),
            "recorded_item_sales_value": M.cents_sum("item_sales_value") / 100,
            "delivered_item_sales_value": M.cents_sum("item_sales_value", delivered) / 100,
            "orders_with_review": F.sum("has_review"),
            "delivery_eligible_orders": F.sum("is_delivery_eligible"),
            "late_orders": M.rows_where(c("is_late") == 1),
            "on_time_or_early_orders": M.rows_where(eligible & (c("is_late") == 0)),
        },
        "fact_order_categories": {
            "completed_item_count": M.sum_where(delivered, c("category_item_count")),
            "completed_item_sales_value": M.cents_sum("category_item_sales_value", delivered)
            / 100,
            "completed_items_missing_category": M.sum_where(
                delivered & c("source_category_name").isNull(), c("category_item_count")
            ),
        },
        "fact_seller_orders": {
            "completed_relationships": F.sum("is_delivered"),
            "completed_item_count": M.sum_where(delivered, c("seller_item_count")),
            "completed_item_sales_value": M.cents_sum("seller_item_sales_value", delivered) / 100,
        },
        "fact_payments": {
            "payment_records": F.count("*"),
            "recorded_payment_value": M.cents_sum("payment_value") / 100,
            "max_payment_records_per_order": F.max("payment_record_count"),
            "max_payment_methods_per_order": F.max("payment_method_count"),
            "non_positive_card_records": M.rows_where(c("installment_band") == "non_positive"),
        },
    }


def fact_totals(star: Star) -> DataFrame:
    """dataset, metric, actual_value: one pass over each fact."""
    money = "decimal(18,2)"
    parts = []
    for fact, metrics in _fact_aggregates().items():
        row = star[fact].agg(
            *[F.coalesce(v, F.lit(0)).cast(money).alias(k) for k, v in metrics.items()]
        )
        pairs = [
            F.struct(F.lit(k).alias("metric"), c(k).alias("actual_value")) for k in metrics
        ]
        parts.append(
            row.select(F.inline(F.array(*pairs))).select(F.lit(fact).alias("dataset"), "*")
        )
    return union_all(parts)


# -- fixed values: published totals on the original data set ------------------------
PUBLISHED_TOTALS = {
    ("fact_orders", "rows"): "99441",
    ("fact_orders", "delivered_orders"): "96478",
    ("fact_orders", "orders_without_items"): "775",
    ("fact_orders", "recorded_item_count"): "112650",
    ("fact_orders", "delivered_item_count"): "110197",
    ("fact_orders", "recorded_item_sales_value"): "13591643.70",
    ("fact_orders", "delivered_item_sales_value"): "13221498.11",
    ("fact_orders", "orders_with_review"): "98673",
    ("fact_orders", "delivery_eligible_orders"): "96470",
    ("fact_orders", "late_orders"): "7826",
    ("fact_orders", "on_time_or_early_orders"): "88644",
    ("fact_order_categories", "completed_item_count"): "110197",
    ("fact_order_categories", "completed_item_sales_value"): "13221498.11",
    ("fact_order_categories", "completed_items_missing_category"): "1537",
    ("fact_seller_orders", "completed_relationships"): "97819",
    ("fact_seller_orders", "completed_item_count"): "110197",
    ("fact_seller_orders", "completed_item_sales_value"): "13221498.11",
    ("fact_payments", "payment_records"): "103886",
    ("fact_payments", "recorded_payment_value"): "16008872.12",
    ("fact_payments", "max_payment_records_per_order"): "29",
    ("fact_payments", "max_payment_methods_per_order"): "2",
    ("fact_payments", "non_positive_card_records"): "2",
}


def fact_reconciliation(
    star: Star, expected: Mapping[tuple[str, str], object] = PUBLISHED_TOTALS
) -> DataFrame:
    """Fact totals against expected values; a metric without one stays out."""
    wanted = F.map_from_arrays(
        F.array(*[F.lit(f"{d}.{m}") for d, m in expected]),
        F.array(*[F.lit(str(v)).cast("decimal(18,2)") for v in expected.values()]),
    )
    rows = fact_totals(star).withColumn(
        "expected_value", wanted[F.concat_ws(".", "dataset", "metric")]
    )
    judged = with_status(
        rows.filter(c("expected_value").isNotNull()), "expected_value", "actual_value"
    )
    return judged.select(
        "dataset", "metric", "expected_value", "actual_value", "validation_status",
        "overall_validation_status",
    )
