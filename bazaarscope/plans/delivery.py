"""Delivery reliability, duration, delay severity and the reviews that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarscope.functions import domain as D
from bazaarscope.functions import metrics as M
from bazaarscope.functions.periods import Periods
from bazaarscope.operators.ordered import histogram, quantiles
from bazaarscope.plans import base as B
from bazaarscope.sources.model import Marketplace

c = F.col
PURCHASE = "order_purchase_timestamp"
CUSTOMER_DATE = "order_delivered_customer_date"
CARRIER_DATE = "order_delivered_carrier_date"
ESTIMATE = "order_estimated_delivery_date"


def population(mk: Marketplace) -> DataFrame:
    row = B.completed_orders(mk).agg(
        F.count("*").alias("delivered_orders"),
        F.count(CUSTOMER_DATE).alias("orders_with_customer_delivery_date"),
        M.rows_where(c(CUSTOMER_DATE).isNull()).alias("orders_missing_customer_delivery_date"),
        F.count(ESTIMATE).alias("orders_with_estimated_delivery_date"),
        M.rows_where(M.is_delivery_eligible()).alias("orders_eligible_for_lateness_analysis"),
    )
    return row.withColumn(
        "lateness_analysis_coverage_pct",
        M.pct(c("orders_eligible_for_lateness_analysis"), c("delivered_orders")),
    )


def chronology(mk: Marketplace) -> DataFrame:
    return B.completed_orders(mk).agg(
        M.rows_where(c(CUSTOMER_DATE) < c(PURCHASE)).alias("delivery_before_purchase"),
        M.rows_where(c(CUSTOMER_DATE) < c(CARRIER_DATE)).alias("customer_delivery_before_carrier"),
        M.rows_where(c(ESTIMATE) < c(PURCHASE)).alias("estimate_before_purchase"),
    )


def _sums() -> list[Column]:
    late = c("late")
    return [
        F.count("*").alias("n"),
        F.sum("delivery_s").alias("delivery_s"),
        F.sum("estimated_s").alias("estimated_s"),
        M.rows_where(late).alias("n_late"),
        F.sum(F.when(late, c("delay_s"))).alias("late_s"),
        F.sum(F.when(~late, -c("delay_s"))).alias("early_s"),
    ]


def _eligible() -> Column:
    return c("n").alias("eligible_delivered_orders")


def _late() -> Column:
    return c("n_late").alias("late_orders")


def _late_rate() -> Column:
    return M.pct(c("n_late"), c("n")).alias("late_delivery_rate_pct")


def _averages() -> list[Column]:
    return [
        M.avg_days2(c("delivery_s"), c("n")).alias("avg_delivery_days"),
        M.avg_days2(c("estimated_s"), c("n")).alias("avg_estimated_delivery_days"),
    ]


def _avg_late() -> Column:
    return M.avg_days2(c("late_s"), c("n_late")).alias("avg_delay_days_for_late_orders")


def _avg_early() -> Column:
    return M.avg_days2(c("early_s"), c("n") - c("n_late")).alias(
        "avg_days_early_for_on_time_orders"
    )


def reliability(mk: Marketplace) -> DataFrame:
    return B.eligible_deliveries(mk).agg(*_sums()).select(
        _eligible(),
        *_averages(),
        (c("n") - c("n_late")).alias("on_time_or_early_orders"),
        _late(),
        _late_rate(),
        _avg_late(),
        _avg_early(),
    )


def percentiles(mk: Marketplace) -> DataFrame:
    """Median, p75, p90, p95 and maximum of delivery time and of late delays, in days."""
    measured = B.eligible_deliveries(mk).select(
        F.explode(
            F.array(
                F.struct(F.lit("delivery").alias("metric"), c("delivery_s").alias("s")),
                F.struct(F.lit("late").alias("metric"), c("delay_s").alias("s")),
            )
        ).alias("m")
    ).select("m.metric", "m.s")
    wanted = measured.filter((c("metric") == "delivery") | (c("s") > 0))
    points = quantiles(
        histogram(wanted, "s", ["metric"]),
        "s",
        c("s"),
        linear={"median": 50},
        nearest={"p75": 75, "p90": 90, "p95": 95, "max": 100},
        by=["metric"],
    )

    def days(metric: str, point: str) -> Column:
        seconds = F.max(F.when(c("metric") == metric, c(point)))
        return M.rounded(seconds / M.SECONDS_PER_DAY)

    return points.agg(
        days("delivery", "median").alias("median_delivery_days"),
        days("delivery", "p75").alias("p75_delivery_days"),
        days("delivery", "p90").alias("p90_delivery_days"),
        days("delivery", "p95").alias("p95_delivery_days"),
        days("delivery", "max").alias("max_delivery_days"),
        days("late", "median").alias("median_late_delay_days"),
        days("late", "p90").alias("p90_late_delay_days"),
        days("late", "p95").alias("p95_late_delay_days"),
        days("late", "max").alias("max_late_delay_days"),
    )


def _over_time(mk: Marketplace, within: Column, label: str, group: Column) -> DataFrame:
    return (
        B.eligible_deliveries(mk)
        .filter(within)
        .groupBy(group.alias(label))
        .agg(*_sums())
        .select(
            label,
            _eligible(),
            *_averages(),
            _late(),
            _late_rate(),
            _avg_late(),
            _avg_early(),
        )
        .orderBy(label)
    )


def by_month(mk: Marketplace, periods: Periods) -> DataFrame:
    return _over_time(mk, periods.in_core(c(PURCHASE)), "order_month", M.month(c(PURCHASE)))


def by_matched_year(mk: Marketplace, periods: Periods) -> DataFrame:
    return _over_time(mk, periods.in_matched(c(PURCHASE)), "order_year", F.year(PURCHASE))


def _reviewed_deliveries(mk: Marketplace) -> DataFrame:
    # an order with a review counts as reviewed even where the score itself is missing
    reviews = B.representative_reviews(mk).withColumn("reviewed", F.lit(True))
    return (
        B.eligible_deliveries(mk)
        .select("order_id", "delay_s", "late")
        .join(reviews, "order_id", "left")
    )


def review_coverage(mk: Marketplace) -> DataFrame:
    reviewed, late = c("reviewed"), c("late")
    row = _reviewed_deliveries(mk).agg(
        F.count("*").alias("n"),
        M.rows_where(reviewed).alias("n_reviewed"),
        M.rows_where(~late).alias("on_time"),
        M.rows_where(~late & reviewed).alias("on_time_reviewed"),
        M.rows_where(late).alias("n_late"),
        M.rows_where(late & reviewed).alias("late_reviewed"),
    )
    return row.select(
        _eligible(),
        c("n_reviewed").alias("reviewed_eligible_orders"),
        (c("n") - c("n_reviewed")).alias("orders_without_review"),
        M.pct(c("n_reviewed"), c("n")).alias("review_coverage_pct"),
        c("on_time").alias("on_time_or_early_orders"),
        c("on_time_reviewed").alias("reviewed_on_time_or_early_orders"),
        M.pct(c("on_time_reviewed"), c("on_time")).alias("on_time_review_coverage_pct"),
        _late(),
        c("late_reviewed").alias("reviewed_late_orders"),
        M.pct(c("late_reviewed"), c("n_late")).alias("late_review_coverage_pct"),
    )


def review_outcome_sums() -> list[Column]:
    score = c("review_score")
    return [
        F.count("*").alias("n"),
        M.rows_where(c("reviewed")).alias("n_reviewed"),
        F.sum(score.cast("bigint")).alias("score_sum"),
        F.count(score).alias("score_n"),
        M.rows_where(score <= D.LOW_REVIEW_MAX).alias("n_low"),
        M.rows_where(score >= D.HIGH_REVIEW_MIN).alias("n_high"),
    ]


def review_outcome_columns() -> list[Column]:
    return [
        M.pct(c("n_reviewed"), c("n")).alias("review_coverage_pct"),
        M.avg2(c("score_sum"), c("score_n")).alias("avg_review_score"),
        M.pct(c("n_low"), c("n_reviewed")).alias("low_review_rate_pct"),
        M.pct(c("n_high"), c("n_reviewed")).alias("high_review_rate_pct"),
    ]


def delay_and_reviews(mk: Marketplace) -> DataFrame:
    bands = (
        _reviewed_deliveries(mk)
        .groupBy(M.delay_band(c("delay_s")).alias("delay_group"))
        .agg(*review_outcome_sums())
    )
    position = M.position_in(c("delay_group"), D.DELAY_BANDS, D.DELAY_BAND_REST)
    return bands.orderBy(position).select(
        "delay_group",
        c("n").alias("eligible_orders"),
        c("n_reviewed").alias("reviewed_orders"),
        *review_outcome_columns(),
    )


def by_state(mk: Marketplace) -> DataFrame:
    states = (
        B.eligible_deliveries(mk)
        .join(mk.customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(*_sums())
    )
    n, late, seconds = B.total("n"), B.total("n_late"), B.total("delivery_s")
    rate_gap = M.raw_pct(c("n_late"), c("n")) - M.raw_pct(late, n)
    day_gap = (M.ratio(c("delivery_s"), c("n")) - M.ratio(seconds, n)) / M.SECONDS_PER_DAY
    return states.select(
        "customer_state",
        _eligible(),
        M.pct(c("n"), n).alias("eligible_order_share_pct"),
        *_averages(),
        _late(),
        _late_rate(),
        M.rounded(rate_gap).alias("late_rate_vs_marketplace_pp"),
        M.rounded(day_gap).alias("delivery_days_vs_marketplace"),
        _avg_late(),
    ).orderBy(c("eligible_delivered_orders").desc(), "customer_state")
