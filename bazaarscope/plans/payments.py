"""Payment structure, method mix, combinations and installment behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarscope.functions import domain as D
from bazaarscope.functions import metrics as M
from bazaarscope.functions.periods import Periods
from bazaarscope.plans import base as B
from bazaarscope.sources.model import Marketplace

c = F.col
PURCHASE = "order_purchase_timestamp"


def _methods_per_order(mk: Marketplace) -> DataFrame:
    """One row per order and method: records, value."""
    return mk.payments.groupBy("order_id", "payment_type").agg(
        F.count("*").alias("records"), M.cents_sum("payment_value").alias("value")
    )


def _paid_orders(per_method: DataFrame) -> DataFrame:
    """One row per order: records, methods and value, counted over its methods."""
    return per_method.groupBy("order_id").agg(
        F.sum("records").alias("records"),
        F.count("payment_type").alias("methods"),
        F.sum("value").alias("value"),
    )


def population(mk: Marketplace) -> DataFrame:
    methods = c("methods")
    row = _paid_orders(_methods_per_order(mk)).agg(
        F.count("*").alias("paid"),
        F.sum("records").alias("records"),
        F.sum("value").alias("value"),
        M.rows_where(c("records") == 1).alias("single"),
        M.rows_where(c("records") > 1).alias("multi"),
        M.rows_where(methods > 1).alias("mixed"),
        F.max("records").alias("most_records"),
        F.max(methods).cast("bigint").alias("most_methods"),
    )
    recorded = mk.orders.agg(F.count("*").alias("n")).scalar()
    return row.withColumn("recorded_orders", recorded).select(
        "recorded_orders",
        c("paid").alias("orders_with_payments"),
        (c("recorded_orders") - c("paid")).alias("orders_without_payments"),
        c("records").alias("payment_records"),
        M.money("value").alias("recorded_payment_value"),
        c("single").alias("single_payment_record_orders"),
        c("multi").alias("multiple_payment_record_orders"),
        M.pct(c("multi"), c("paid")).alias("multiple_payment_record_order_pct"),
        c("mixed").alias("multiple_payment_method_orders"),
        M.pct(c("mixed"), c("paid")).alias("multiple_payment_method_order_pct"),
        M.avg2(c("records"), c("paid")).alias("avg_payment_records_per_paid_order"),
        c("most_records").alias("max_payment_records_per_order"),
        c("most_methods").alias("max_payment_methods_per_order"),
    )


def method_mix(mk: Marketplace) -> DataFrame:
    per_method = _methods_per_order(mk)
    paid = _paid_orders(per_method).agg(F.count("*").alias("n")).scalar()
    methods = per_method.groupBy("payment_type").agg(
        F.sum("records").alias("records"),
        F.count("*").alias("orders"),
        F.sum("value").alias("value"),
    )
    return methods.withColumn("paid", paid).select(
        "payment_type",
        c("records").alias("payment_records"),
        M.pct(c("records"), B.total("records")).alias("payment_record_share_pct"),
        c("orders").alias("orders_using_method"),
        M.pct(c("orders"), c("paid")).alias("paid_order_usage_pct"),
        M.money("value").alias("recorded_payment_value"),
        M.pct(c("value"), B.total("value")).alias("payment_value_share_pct"),
        M.avg_money("value", c("records")).alias("avg_payment_record_value"),
    ).orderBy(c("recorded_payment_value").desc(), "payment_type")


def method_combinations(mk: Marketplace) -> DataFrame:
    """Orders paid with several methods, by the sorted set of methods."""
    per_method = _methods_per_order(mk)
    several = _paid_orders(per_method).filter(c("methods") > 1).select("order_id", "value")
    # texts are built only for the few orders with several methods
    named = (
        per_method.select("order_id", "payment_type")
        .join(several, "order_id")
        .groupBy("order_id", "value")
        .agg(F.array_sort(F.collect_list("payment_type")).alias("methods"))
    )
    groups = (
        named.groupBy(F.array_join("methods", " + ").alias("payment_method_combination"))
        .agg(F.count("*").alias("orders"), F.sum("value").alias("value"))
    )
    return groups.select(
        "payment_method_combination",
        c("orders").alias("mixed_payment_orders"),
        M.pct(c("orders"), B.total("orders")).alias("mixed_order_share_pct"),
        M.avg_money("value", c("orders")).alias("avg_order_payment_value"),
    ).orderBy(c("mixed_payment_orders").desc(), "payment_method_combination")


def _card_payments(mk: Marketplace) -> DataFrame:
    return mk.payments.filter(c("payment_type") == D.CARD_TYPE)


def _card_columns() -> list[Column]:
    return [
        M.pct(c("records"), B.total("records")).alias("payment_record_share_pct"),
        M.money("value").alias("recorded_credit_card_value"),
        M.avg_money("value", c("records")).alias("avg_credit_card_payment_value"),
    ]


def installment_distribution(mk: Marketplace) -> DataFrame:
    counts = (
        _card_payments(mk)
        .groupBy("payment_installments")
        .agg(
            F.count("*").alias("records"),
            F.count_distinct("order_id").alias("orders"),
            M.cents_sum("payment_value").alias("value"),
        )
    )
    return counts.select(
        "payment_installments",
        c("records").alias("credit_card_payment_records"),
        c("orders").alias("orders_using_installment_count"),
        *_card_columns(),
    ).orderBy("payment_installments")


def installment_bands(mk: Marketplace) -> DataFrame:
    band = M.installment_band(c("payment_installments"))
    groups = (
        _card_payments(mk)
        .groupBy(band.alias("installment_group"))
        .agg(F.count("*").alias("records"), M.cents_sum("payment_value").alias("value"))
    )
    position = M.position_in(
        c("installment_group"), D.INSTALLMENT_BANDS, D.INSTALLMENT_BAND_REST
    )
    return groups.orderBy(position).select(
        "installment_group",
        c("records").alias("credit_card_payment_records"),
        *_card_columns(),
    )


def by_month_and_method(mk: Marketplace, periods: Periods) -> DataFrame:
    orders = mk.orders.filter(periods.in_core(c(PURCHASE))).select(
        "order_id", M.month(c(PURCHASE)).alias("order_month")
    )
    # the period's orders meet their payments before anything is grouped
    rows = (
        mk.payments.select("order_id", "payment_type", "payment_value")
        .join(orders, "order_id")
        .groupBy("order_month", "order_id", "payment_type")
        .agg(M.cents_sum("payment_value").alias("value"))
    )
    paid = rows.groupBy("order_month", "order_id").agg(F.count("*").alias("n"))
    paid = paid.groupBy("order_month").agg(F.count("*").alias("paid"))
    groups = (
        rows.groupBy("order_month", "payment_type")
        .agg(F.count("*").alias("orders"), F.sum("value").alias("value"))
        .join(paid, "order_month")
    )
    of_month = Window.partitionBy("order_month")
    return groups.select(
        "order_month",
        "payment_type",
        c("orders").alias("orders_using_method"),
        M.pct(c("orders"), c("paid")).alias("paid_order_usage_pct"),
        M.money("value").alias("recorded_payment_value"),
        M.pct(c("value"), F.sum("value").over(of_month)).alias("payment_value_share_pct"),
    ).orderBy("order_month", c("recorded_payment_value").desc(), "payment_type")
