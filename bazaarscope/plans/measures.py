"""Named measures over the facts, evaluated under any grouping and filter.

A measure is a set of aggregates over one fact and an expression over their results, so
ratios are always taken after aggregation and in the filter at hand. ``evaluate`` computes
any number of measures of one fact in a single aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarscope.functions import domain as D
from bazaarscope.functions import metrics as M
from bazaarscope.functions.periods import Periods
from bazaarscope.plans.facts import LINKS, Star

c = F.col
Aggregates = Callable[[], dict[str, Column]]


@dataclass(frozen=True)
class Measure:
    """``parts`` are names of aggregates; ``value`` combines their results.

    ``lifted`` names a column whose filter and grouping the parts in ``base`` ignore, such
    as the category in a share of all categories.
    """

    fact: str
    parts: tuple[str, ...]
    value: Callable[..., Column] = field(default=lambda x: x)
    base: tuple[str, ...] = ()
    lifted: str | None = None


# -- aggregates per fact, by name ------------------------------------------------------
def _order_parts() -> dict[str, Column]:
    done, eligible = c("is_delivered") == 1, c("is_delivery_eligible") == 1
    score, late = c("representative_review_score"), c("is_late") == 1
    return {
        "orders": F.count("*"),
        "done": F.sum("is_delivered"),
        "items": F.sum("item_count"),
        "items_done": M.sum_where(done, c("item_count")),
        "sales": M.cents_sum("item_sales_value") / 100,
        "sales_done": M.cents_sum("item_sales_value", done) / 100,
        "eligible": F.sum("is_delivery_eligible"),
        "on_time": M.rows_where(eligible & (c("is_late") == 0)),
        "late": M.rows_where(late),
        "delivery_days": F.sum("delivery_days"),
        "late_days": F.sum(F.when(late, c("late_days"))),
        "reviewed": F.sum("has_review"),
        "score": F.sum(score.cast("bigint")),
        "scored": F.count(score),
        "low": M.rows_where(score <= D.LOW_REVIEW_MAX),
        "high": M.rows_where(score >= D.HIGH_REVIEW_MIN),
    }


def _person_parts() -> dict[str, Column]:
    """Over one row per person of the context: orders, orders_done, sales_done."""
    done = c("orders_done")
    return {
        "people": F.count("customer_unique_id"),
        "people_done": M.rows_where(done > 0),
        "repeat": M.rows_where(done > 1),
        "one_time": M.rows_where(done == 1),
        "repeat_orders": M.sum_where(done > 1, done),
        "person_orders": F.coalesce(F.sum(done), F.lit(0)),
        "one_time_sales": M.sum_where(done == 1, c("sales_done")) / 100,
        "repeat_sales": M.sum_where(done > 1, c("sales_done")) / 100,
        "person_sales": F.coalesce(F.sum("sales_done"), F.lit(0)) / 100,
    }


def _category_parts() -> dict[str, Column]:
    done, score = c("is_delivered") == 1, c("representative_review_score")
    return {
        "orders": F.count_distinct(F.when(done, c("order_id"))),
        "items": M.sum_where(done, c("category_item_count")),
        "sales": M.cents_sum("category_item_sales_value", done) / 100,
        "reviewed": F.sum("has_review"),
        "score": F.sum(score.cast("bigint")),
        "scored": F.count(score),
        "low": M.rows_where(score <= D.LOW_REVIEW_MAX),
    }


def _seller_parts() -> dict[str, Column]:
    done = c("is_delivered") == 1
    return {
        "sellers": F.count_distinct(F.when(done, c("seller_id"))),
        "relationships": F.sum("is_delivered"),
        "items": M.sum_where(done, c("seller_item_count")),
        "sales": M.cents_sum("seller_item_sales_value", done) / 100,
    }


def _per_paid_order(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per order of the context, so that orders are counted without a distinct count."""
    card = c("payment_type") == D.CARD_TYPE
    return rows.groupBy(*by, "order_id").agg(
        F.max("is_multi_payment_order").alias("is_multi"),
        F.max("is_multi_method_order").alias("is_mixed"),
        F.count("*").alias("records"),
        M.cents_sum("payment_value").alias("cents"),
        M.rows_where(card).alias("card"),
        M.rows_where(card & (c("payment_installments") > 1)).alias("card_multi"),
        F.sum(F.when(card, M.cents(c("payment_value")))).alias("card_cents"),
    )


def _payment_parts() -> dict[str, Column]:
    """Over the rows of ``_per_paid_order``."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0).cast("bigint"))

    return {
        "orders": F.count("order_id"),
        "multi": F.count(F.when(c("is_multi") == 1, c("order_id"))),
        "mixed": F.count(F.when(c("is_mixed") == 1, c("order_id"))),
        "records": total("records"),
        "value": F.sum("cents") / 100,
        "card": total("card"),
        "card_multi": total("card_multi"),
        "card_value": F.sum("card_cents") / 100,
    }


_PARTS: dict[str, Aggregates] = {
    "fact_orders": _order_parts,
    "persons": _person_parts,
    "fact_order_categories": _category_parts,
    "fact_seller_orders": _seller_parts,
    "fact_payments": _payment_parts,
}


def _of(fact: str, entries) -> dict[str, Measure]:
    out = {}
    for name, parts in entries.items():
        if isinstance(parts, str):
            out[name] = Measure(fact, (parts,))
        else:
            out[name] = Measure(fact, tuple(parts), M.ratio)
    return out


MEASURES: dict[str, Measure] = {
    # a name alone is an aggregate, a pair is their ratio
    **_of("fact_orders", {
        "recorded_orders": "orders",
        "completed_orders": "done",
        "completion_rate": ("done", "orders"),
        "recorded_items": "items",
        "completed_items": "items_done",
        "recorded_item_sales_value": "sales",
        "completed_item_sales_value": "sales_done",
        "avg_item_sales_value_per_completed_order": ("sales_done", "done"),
        "delivery_eligible_orders": "eligible",
        "on_time_or_early_orders": "on_time",
        "late_orders": "late",
        "late_delivery_rate": ("late", "eligible"),
        "avg_delivery_days": ("delivery_days", "eligible"),
        "avg_late_days": ("late_days", "late"),
        "reviewed_orders": "reviewed",
        "avg_review_score": ("score", "scored"),
        "low_review_orders": "low",
        "low_review_rate": ("low", "reviewed"),
        "high_review_orders": "high",
        "high_review_rate": ("high", "reviewed"),
    }),
    **_of("persons", {
        "recorded_unique_customers": "people",
        "completed_unique_customers": "people_done",
        "observed_repeat_customers": "repeat",
        "observed_repeat_customer_rate": ("repeat", "people_done"),
        "one_time_completed_customers": "one_time",
        "repeat_customer_completed_orders": "repeat_orders",
        "repeat_customer_order_share": ("repeat_orders", "person_orders"),
        "one_time_customer_item_sales_value": "one_time_sales",
        "repeat_customer_item_sales_value": "repeat_sales",
        "repeat_customer_item_sales_value_share": ("repeat_sales", "person_sales"),
        "avg_completed_orders_per_customer": ("person_orders", "people_done"),
        "avg_completed_orders_per_repeat_customer": ("repeat_orders", "repeat"),
    }),
    **_of("fact_order_categories", {
        "category_completed_orders": "orders",
        "category_items_sold": "items",
        "category_item_sales_value": "sales",
        "category_avg_review_score": ("score", "scored"),
        "category_low_review_rate": ("low", "reviewed"),
    }),
    "category_marketplace_share": Measure(
        "fact_order_categories", ("sales",), M.ratio, base=("sales",), lifted="category_key"
    ),
    **_of("fact_seller_orders", {
        "active_sellers": "sellers",
        "seller_order_relationships": "relationships",
        "seller_items_sold": "items",
        "seller_item_sales_value": "sales",
        "avg_seller_orders": ("relationships", "sellers"),
        "avg_item_sales_value_per_seller": ("sales", "sellers"),
    }),
    **_of("fact_payments", {
        "paid_orders": "orders",
        "payment_records": "records",
        "recorded_payment_value": "value",
        "avg_payment_records_per_paid_order": ("records", "orders"),
        "multi_payment_orders": "multi",
        "multi_payment_order_rate": ("multi", "orders"),
        "mixed_method_orders": "mixed",
        "mixed_method_order_rate": ("mixed", "orders"),
        "orders_using_payment_method": "orders",
        "payment_value_by_method": "value",
        "credit_card_payment_records": "card",
        "multi_installment_credit_card_records": "card_multi",
        "multi_installment_rate": ("card_multi", "card"),
        "avg_credit_card_payment_value": ("card_value", "card"),
    }),
    "payment_method_order_usage_rate": Measure(
        "fact_payments", ("orders",), M.ratio, base=("orders",), lifted="payment_type"
    ),
    "payment_value_share": Measure(
        "fact_payments", ("value",), M.ratio, base=("value",), lifted="payment_type"
    ),
}

# columns that vary only with the lifted one and are lifted along with it
_LIFTED_WITH = {
    "category_key": {"category_key", "category_display_name", "source_category_name"},
    "payment_type": {"payment_type", "installment_band"},
}


def _source(star: Star, fact: str) -> DataFrame:
    return star["fact_orders" if fact == "persons" else fact]


def _aggregate(rows: DataFrame, fact: str, by: Sequence[str], parts: set[str]) -> DataFrame:
    if fact == "persons":
        # repeat status is decided inside the context: first per person, then per group
        rows = rows.groupBy(*by, "customer_unique_id").agg(
            F.sum("is_delivered").alias("orders_done"),
            M.cents_sum("item_sales_value", c("is_delivered") == 1).alias("sales_done"),
        )
    if fact == "fact_payments":
        rows = _per_paid_order(rows, by)
    return _totals(rows, fact, by, parts)


def _totals(rows: DataFrame, fact: str, by: Sequence[str], parts: set[str]) -> DataFrame:
    available = _PARTS[fact]()
    return rows.groupBy(*by).agg(*[available[p].alias(p) for p in sorted(parts)])


def _merged_paid_orders(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``_per_paid_order`` over a finer grouping, made one row per order again."""
    return rows.groupBy(*by, "order_id").agg(
        *[F.max(name).alias(name) for name in ("is_multi", "is_mixed")],
        *[F.sum(name).alias(name) for name in ("records", "cents", "card", "card_multi", "card_cents")],
    )


_BOTH = ("_chosen", "_whole")


def _with_whole(
    rows: DataFrame, fact: str, by: Sequence[str], kept: Sequence[str], parts: set[str], base: set[str]
) -> DataFrame:
    """Parts of the selected rows per group of ``by``, and beside them ``all_<part>`` of all
    rows per group of ``kept``, from one pass over the fact.

    ``rows`` has a column ``_chosen``. Rows are first reduced to the finest grouping that both
    contexts need; only what is left is given to each context it belongs to.
    """
    lifted = [column for column in by if column not in kept]
    own = [c(column) for column in by]
    above = [F.lit(None).alias(column) if column in lifted else c(column) for column in by]
    if fact == "fact_payments":
        fine = _per_paid_order(rows, [*by, "_chosen"])
        values = [name for name in fine.columns if name not in (*by, "_chosen")]
        selection = F.struct(F.lit(False).alias("_whole"), *own)
        whole = F.struct(F.lit(True).alias("_whole"), *above)
        contexts = F.array_compact(F.array(F.when(c("_chosen"), selection), whole))
        spread = fine.select(F.explode(contexts).alias("_context"), *values)
        spread = spread.select("_context.*", *values)
        grouped = _totals(_merged_paid_orders(spread, ["_whole", *by]), fact, ["_whole", *by], parts | base)
        grouped = grouped.withColumn("_chosen", ~c("_whole"))
        of_whole = {b: F.max(F.when(c("_whole"), c(b))) for b in base}
    else:
        # the parts of a base are sums, so those of the whole are sums of those of its groups
        grouped = _totals(rows, fact, [*by, "_chosen"], parts | base)
        of_whole = {b: F.sum(b) for b in base}
    groups = Window.partitionBy(*kept)
    beside = grouped.select("*", *[value.over(groups).alias(f"all_{b}") for b, value in of_whole.items()])
    return beside.where("_chosen").drop(*_BOTH)


# dimensions whose selection share measures lift in their denominator
_LIFTED_DIMENSIONS = {"dim_category"}


def _members(
    star: Star, fact: str, dimensions: Mapping[str, Column], lifted: bool
) -> list[tuple[str, DataFrame]]:
    """Fact keys and the members that pass the filters of the dimensions linked to this fact.

    A filter on a dimension without a link to the fact does not reach it.
    """
    stored = "fact_orders" if fact == "persons" else fact
    return [
        (key, star[dimension].filter(dimensions[dimension]).select(c(member).alias("_member")))
        for linked, key, dimension, member in LINKS
        if linked == stored and dimension in dimensions and (dimension in _LIFTED_DIMENSIONS) == lifted
    ]


def evaluate(
    star: Star,
    names: Sequence[str],
    by: Sequence[str] = (),
    where: Column | None = None,
    only: Column | None = None,
    dimensions: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Measures of one fact per group of ``by``.

    ``where`` is the context of everything. ``only`` is a selection of categories or
    payment methods: share measures ignore it in their denominator. ``dimensions`` filters
    members of dimensions and reaches the fact over its links.
    """
    chosen = {name: MEASURES[name] for name in names}
    facts = {m.fact for m in chosen.values()}
    if len(facts) != 1:
        raise ValueError(f"measures of one fact at a time, got {sorted(facts)}")
    fact = facts.pop()
    context = _source(star, fact)
    if where is not None:
        context = context.filter(where)
    filters = dimensions or {}
    for key, members in _members(star, fact, filters, lifted=False):
        context = context.join(members, c(key) == c("_member"), "left_semi")
    chosen_members = _members(star, fact, filters, lifted=True)
    parts = {p for m in chosen.values() for p in m.parts}
    lifted = {m.lifted for m in chosen.values() if m.lifted}
    if lifted and by:
        (lifted_column,) = lifted
        base = {p for m in chosen.values() for p in m.base}
        kept = [column for column in by if column not in _LIFTED_WITH[lifted_column]]
        test = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
        for i, (key, members) in enumerate(chosen_members):
            # members are a key of their dimension, so no row is doubled
            known = members.distinct().withColumnRenamed("_member", f"_member_{i}")
            context = context.join(known, c(key) == c(f"_member_{i}"), "left")
            test = test & c(f"_member_{i}").isNotNull()
        result = _with_whole(context.withColumn("_chosen", test), fact, by, kept, parts, base)
    else:
        selected = context if only is None else context.filter(only)
        for key, members in chosen_members:
            selected = selected.join(members, c(key) == c("_member"), "left_semi")
        result = _aggregate(selected, fact, by, parts)
        for b in {p for m in chosen.values() for p in m.base}:
            whole = _aggregate(context, fact, (), {b})
            result = result.withColumn(f"all_{b}", whole.scalar())
    values = [
        m.value(*[c(p) for p in m.parts], *[c(f"all_{b}") for b in m.base]).alias(name)
        for name, m in chosen.items()
    ]
    return result.select(*by, *values)


def matched(
    star: Star,
    names: Sequence[str],
    periods: Periods,
    by: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """Each measure in both matched years and its growth; no growth from nothing.

    Output columns: <name>_<year> twice and <name>_growth_pct.
    """
    before, after = periods.years
    day = c("order_purchase_date").cast("timestamp_ntz")
    context = periods.in_matched(day) if where is None else periods.in_matched(day) & where
    fact = _source(star, MEASURES[names[0]].fact).withColumn(
        "matched_year", F.year("order_purchase_date")
    )
    name = "fact_orders" if MEASURES[names[0]].fact == "persons" else MEASURES[names[0]].fact
    yearly = evaluate(Star({name: fact}), names, [*by, "matched_year"], context)

    def of(measure: str, year: int) -> Column:
        return F.max(F.when(c("matched_year") == year, c(measure))).alias(f"{measure}_{year}")

    wide = yearly.groupBy(*by).agg(*[of(n, y) for n in names for y in (before, after)])
    growth = [
        M.growth_pct(c(f"{n}_{after}"), c(f"{n}_{before}")).alias(f"{n}_growth_pct")
        for n in names
    ]
    return wide.select("*", *growth)


def category_matched(star: Star, periods: Periods) -> DataFrame:
    """Category sales in both matched years: change, growth, share change, contribution."""
    before, after = periods.years
    names = ["category_item_sales_value", "category_marketplace_share"]
    by = ["category_key", "category_display_name"]
    rows = matched(star, names, periods, by)
    old, new = (
        F.coalesce(c(f"category_item_sales_value_{y}"), F.lit(0)) for y in (before, after)
    )
    share_old, share_new = (
        F.coalesce(c(f"category_marketplace_share_{y}"), F.lit(0.0)) for y in (before, after)
    )
    # one row per category, so the window holds no more than these
    change = F.sum(new - old).over(Window.partitionBy())
    return rows.select(
        *by,
        M.rounded(old).alias(f"item_sales_value_{before}"),
        M.rounded(new).alias(f"item_sales_value_{after}"),
        M.rounded(new - old).alias("absolute_growth"),
        M.growth_pct(new, old).alias("growth_pct"),
        M.rounded(100 * share_old).alias(f"marketplace_share_{before}_pct"),
        M.rounded(100 * share_new).alias(f"marketplace_share_{after}_pct"),
        M.rounded(100 * (share_new - share_old)).alias("share_change_pp"),
        M.pct(new - old, change).alias("growth_contribution_pct"),
    )


def sliced(
    rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str, where: Column
) -> DataFrame:
    """Fact rows whose dimension member satisfies a filter."""
    members = dimension.filter(where).select(c(dimension_key).alias(key))
    return rows.join(members, key, "left_semi")
