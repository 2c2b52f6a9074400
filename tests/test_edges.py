"""Business rules at their edges, on literal rows."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from bazaarscope.functions.periods import PUBLISHED
from bazaarscope.operators.keys import dense_ids, key_profile, latest_per_key
from bazaarscope.plans import audit, categories, customers, delivery, facts, marketplace
from bazaarscope.plans import payments as pay
from bazaarscope.plans import reconcile, sellers
from tests.market import (
    DAY0,
    at,
    by,
    customer,
    item,
    market,
    one,
    order,
    payment,
    product,
    review,
    seller,
)

ESTIMATE = at(10)


def delivered_after(order_id, days, seconds=0):
    """An order delivered so long after its estimate."""
    late = ESTIMATE + timedelta(days=days, seconds=seconds)
    return order(order_id, delivered=late, estimated=ESTIMATE)


DELAYS = {
    "on_time_or_early": [(-5, 0), (0, 0)],
    "over_0_to_3_days_late": [(0, 1), (3, 0)],
    "over_3_to_7_days_late": [(3, 1), (7, 0)],
    "over_7_to_14_days_late": [(7, 1), (14, 0)],
    "over_14_to_30_days_late": [(14, 1), (30, 0)],
    "over_30_days_late": [(30, 1), (90, 0)],
}


def test_delay_band_edges(spark):
    orders = [
        delivered_after(f"{band}-{i}", d, s)
        for band, delays in DELAYS.items()
        for i, (d, s) in enumerate(delays)
    ]
    mk = market(spark, orders=orders, customers=[customer("c1")])
    got = by(delivery.delay_and_reviews(mk), "delay_group")
    assert {band: row["eligible_orders"] for band, row in got.items()} == {
        band: len(delays) for band, delays in DELAYS.items()
    }
    assert list(got) == list(DELAYS)
    fact = by(facts.fact_orders(mk), "order_id")
    for band, delays in DELAYS.items():
        for i, (days, seconds) in enumerate(delays):
            row = fact[f"{band}-{i}"]
            assert row["delay_band"] == band
            assert row["is_late"] == int((days, seconds) > (0, 0))
            assert row["delivery_variance_days"] == pytest.approx(days + seconds / 86400)
            assert row["late_days"] == pytest.approx(max(0, days + seconds / 86400))


def test_only_delivered_orders_with_both_dates_are_eligible(spark):
    mk = market(
        spark,
        orders=[
            order("ok", delivered=at(5)),
            order("shipped", status="shipped", delivered=at(5)),
            order("no date"),
        ],
        customers=[customer("c1")],
    )
    fact = by(facts.fact_orders(mk), "order_id")
    assert {k: v["is_delivery_eligible"] for k, v in fact.items()} == {
        "ok": 1, "shipped": 0, "no date": 0,
    }
    assert fact["shipped"]["is_late"] is None
    assert fact["no date"]["delay_band"] == "not_eligible"
    row = one(delivery.population(mk))
    assert row["delivered_orders"] == 2
    assert row["orders_missing_customer_delivery_date"] == 1
    assert row["lateness_analysis_coverage_pct"] == 50.0


def test_representative_review(spark):
    mk = market(
        spark,
        orders=[order(o, delivered=at(5)) for o in ("none", "one", "two", "tie")],
        customers=[customer("c1")],
        reviews=[
            review("r1", "one", 4),
            review("r2", "two", 1, answered=at(1)),
            review("r3", "two", 5, answered=at(2)),
            review("r5", "tie", 2),
            review("r4", "tie", 5),
        ],
    )
    got = by(facts.fact_orders(mk), "order_id")
    scores = {k: v["representative_review_score"] for k, v in got.items()}
    assert scores == {"none": None, "one": 4, "two": 5, "tie": 2}
    row = one(delivery.review_coverage(mk))
    assert (row["reviewed_eligible_orders"], row["orders_without_review"]) == (3, 1)
    band = by(delivery.delay_and_reviews(mk), "delay_group")["on_time_or_early"]
    assert band["low_review_rate_pct"] == 33.33
    assert band["high_review_rate_pct"] == 66.67
    assert band["avg_review_score"] == 3.67


def test_latest_review_without_answer_time_loses(spark):
    rows = spark.createDataFrame(
        [("o", "a", None, 1), ("o", "b", 5, 2)], "k string, id string, t int, score int"
    )
    assert one(latest_per_key(rows, "k", ["t", "id"], ["score"])) == {"k": "o", "score": 2}


INSTALLMENTS = {
    0: "non_positive", 1: "1_installment", 2: "2_to_3_installments", 3: "2_to_3_installments",
    6: "4_to_6_installments", 12: "7_to_12_installments", 13: "13_plus_installments",
}


def test_installment_bands_and_flags(spark):
    rows = [payment(f"o{n}", installments=n) for n in INSTALLMENTS]
    rows += [payment("mix", 1, "voucher"), payment("mix", 2, "boleto", value="0.00")]
    orders = [order(p) for p in {r[0] for r in rows}]
    mk = market(spark, payments=rows, orders=orders)
    fact = {(r.order_id, r.payment_sequential): r for r in facts.fact_payments(mk).collect()}
    for n, band in INSTALLMENTS.items():
        assert fact[(f"o{n}", 1)].installment_band == band
    assert fact[("mix", 1)].installment_band == "not_applicable"
    assert fact[("mix", 2)].is_multi_method_order == 1
    mixed = one(pay.method_combinations(mk))
    assert mixed["payment_method_combination"] == "boleto + voucher"
    assert one(pay.population(mk))["multiple_payment_method_orders"] == 1
    bands = by(pay.installment_bands(mk), "installment_group")
    assert bands["2_to_3_installments"]["credit_card_payment_records"] == 2


def test_categories_missing_untranslated_and_equal_labels(spark):
    mk = market(
        spark,
        orders=[order("o1")],
        customers=[customer("c1")],
        products=[
            product("p1", "a"), product("p2", "b"), product("p3", "toys"), product("p4"),
        ],
        category_translation=[("a", "toys"), ("b", "books")],
        order_items=[item("o1", i, f"p{i}", price=f"{i}.00") for i in (1, 2, 3, 4)],
    )
    rows = categories.performance(mk).collect()
    # source a is translated to the same label that source toys keeps: both stay
    assert sorted(r.category_name for r in rows) == ["books", "toys", "toys", "unknown"]
    row = one(categories.population(mk))
    assert row["items_missing_category"] == 1
    assert row["items_with_untranslated_category"] == 1
    assert row["sales_value_untranslated_category"] == 3.0
    assert row["represented_source_categories"] == 3
    assert row["represented_translated_categories"] == 2
    dim = by(facts.dim_category(mk), "category_key")
    assert dim["__unknown__"]["translation_status"] == "missing_source_category"
    assert dim["__unknown__"]["category_display_name"] == "Unknown"
    assert dim["toys"]["translation_status"] == "untranslated"


def test_growth_from_nothing_is_null(spark):
    first, second = DAY0, DAY0.replace(year=2018)
    mk = market(
        spark,
        orders=[order("a", bought=first), order("b", bought=second)],
        customers=[customer("c1")],
        products=[product("p1", "old"), product("p2", "new")],
        order_items=[
            item("a", 1, "p1", price="10.00"), item("b", 1, "p1", price="15.00"),
            item("b", 2, "p2", price="5.00"),
        ],
    )
    got = by(categories.growth(mk, PUBLISHED), "category_name")
    assert got["new"]["item_sales_value_growth_pct"] is None
    assert got["old"]["item_sales_value_growth_pct"] == 50.0
    assert got["old"]["contribution_to_sales_growth_pct"] == 50.0
    assert got["new"]["marketplace_share_change_pp"] == 25.0
    growth = one(marketplace.matched_period_growth(mk, PUBLISHED))
    assert growth["completed_item_sales_value_growth_pct"] == 100.0


def test_period_bounds_are_half_open(spark):
    rows = [
        order("in", bought=DAY0.replace(month=1, day=1, hour=0)),
        order("last", bought=DAY0.replace(year=2018, month=8, day=31, hour=23)),
        order("out", bought=DAY0.replace(year=2018, month=9, day=1, hour=0)),
        order("gap", bought=DAY0.replace(month=9, day=1, hour=0)),
    ]
    mk = market(spark, orders=rows)
    ts = F.col("order_purchase_timestamp")
    core = mk.orders.filter(PUBLISHED.in_core(ts)).select("order_id").collect()
    assert {r.order_id for r in core} == {"in", "last", "gap"}
    matched = mk.orders.filter(PUBLISHED.in_matched(ts)).select("order_id").collect()
    assert {r.order_id for r in matched} == {"in", "last"}


def test_order_without_items_and_two_sellers(spark):
    mk = market(
        spark,
        orders=[order("empty"), order("two"), order("open", status="created")],
        customers=[customer("c1")],
        sellers=[seller("s1"), seller("s2", "RJ")],
        products=[product("p1", "a")],
        order_items=[item("two", 1, seller="s1"), item("two", 2, seller="s2"), item("open")],
    )
    row = one(sellers.population(mk))
    assert row["completed_orders_without_items"] == 1
    assert row["multi_seller_orders"] == 1
    assert row["seller_order_relationships"] == 2
    status = by(marketplace.merchandise_by_status(mk), "order_status")
    assert status["delivered"]["recorded_orders"] == 2
    assert status["delivered"]["orders_with_items"] == 1
    scale = one(marketplace.scale(mk))
    assert scale["avg_items_per_completed_order"] == 1.0
    assert scale["recorded_items"] == 3 and scale["completed_items"] == 2


def test_repeat_customer_over_two_records_and_states(spark):
    mk = market(
        spark,
        orders=[order("o1", "c1"), order("o2", "c2"), order("o3", "c3")],
        customers=[
            customer("c1", "person", "SP"), customer("c2", "person", "RJ"), customer("c3"),
        ],
        products=[product("p1")],
        order_items=[item("o1"), item("o2"), item("o3")],
    )
    row = one(customers.base_and_repeat(mk))
    assert row["completed_unique_customers"] == 2
    assert row["completed_repeat_customers"] == 1
    assert row["avg_completed_orders_per_repeat_customer"] == 2.0
    states = by(customers.geography(mk), "customer_state")
    # the person is repeat in both states although each holds one order
    assert states["RJ"]["completed_repeat_customers"] == 1
    assert states["SP"]["completed_unique_customers"] == 2


def test_partition_identities(spark, sf_dir):
    from bazaarscope.sources.bindings import bind

    mk = bind(spark, sf_dir)
    frequency = customers.order_frequency(mk).collect()
    kinds = by(customers.base_and_repeat(mk), "recorded_unique_customers")
    (base,) = kinds.values()
    assert sum(r.customer_count for r in frequency) == base["completed_unique_customers"]
    row = one(delivery.reliability(mk))
    assert row["on_time_or_early_orders"] + row["late_orders"] == row["eligible_delivered_orders"]
    decile = customers.value_deciles(mk).collect()
    sizes = [r.customer_count for r in decile]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 10


def test_reconciliation_passes_only_when_all_agree(spark):
    mk = market(
        spark,
        orders=[order("o1", delivered=at(5))],
        customers=[customer("c1")],
        order_items=[item("o1", price="10.00")],
        payments=[payment("o1")],
    )
    expected = {
        "completed_orders": 1, "completed_item_sales_value": "10.00",
        "completed_unique_customers": 1, "repeat_completed_customers": 0,
        "eligible_delivery_orders": 1, "late_orders": 0, "completed_products": 1,
        "completed_sellers": 1, "paid_orders": 1,
    }
    rows = reconcile.reconciliation(mk, expected).collect()
    assert len(rows) == 11
    assert {r.overall_validation_status for r in rows} == {"ALL CHECKS PASS"}
    rows = reconcile.reconciliation(mk, {**expected, "late_orders": 1}).collect()
    assert {r.overall_validation_status for r in rows} == {"REVIEW FAILURES"}
    assert [r.check_name for r in rows if r.validation_status == "FAIL"] == ["late_orders"]


def test_key_profile_counts_null_parts(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, None), (None, None)], "a int, b int")
    assert one(key_profile(rows, ["a", "b"])) == {
        "total_rows": 4, "unique_combinations": 3, "missing_key_rows": 2,
    }


def test_dense_ids_are_dense_and_stable(spark):
    rows = spark.range(1000).select((F.col("id") * 7).alias("x"))
    first = {r.x: r.n for r in dense_ids(rows, "n", buckets=16).collect()}
    again = {r.x: r.n for r in dense_ids(rows.repartition(5), "n", buckets=16).collect()}
    assert first == again
    assert sorted(first.values()) == list(range(1, 1001))


def test_geolocation_duplicates(spark):
    near = ("01000", 1.0, 2.0, "sao paulo", "SP")
    rows = [near, near, ("01000", 1.0, 2.0, "são paulo", "SP")]
    mk = market(spark, geolocation=rows)
    found = by(audit.duplicates(mk), "table_name")["geolocation"]
    assert found["duplicate_groups"] == 1
    assert found["excess_duplicate_rows"] == 1
    assert one(audit.geolocation_density(mk))["maximum_rows_per_zip_prefix"] == 3


def test_collation_merges_spellings(spark):
    mk = market(
        spark,
        orders=[order("o1")],
        customers=[customer("c1")],
        products=[product("p1", "Brinquedos"), product("p2", "brinquedos")],
        order_items=[item("o1", 1, "p1"), item("o1", 2, "p2")],
    )
    assert categories.performance(mk).count() == 2
    assert categories.performance(mk.collated()).count() == 1


def test_empty_tables_give_zero_counts_and_null_ratios(spark):
    row = one(marketplace.scale(market(spark)))
    assert row["recorded_orders"] == row["completed_items"] == row["recorded_sellers"] == 0
    assert row["completed_order_rate_pct"] is None
    assert row["recorded_item_sales_value"] is None
    assert marketplace.concentration(market(spark)).count() == 0
    assert customers.value_deciles(market(spark)).count() == 0
    assert one(delivery.percentiles(market(spark)))["median_delivery_days"] is None
