"""Measures under filters."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from bazaarscope.functions.periods import PUBLISHED
from bazaarscope.plans import facts, measure_checks, star_checks
from bazaarscope.plans import measures as ms
from bazaarscope.plans.facts import Star
from bazaarscope.sources import bindings
from tests.market import (
    DAY0,
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


@pytest.fixture(scope="module")
def star(spark):
    june = DAY0 + timedelta(days=100)
    mk = market(
        spark,
        orders=[
            order("o1", "c1", bought=DAY0), order("o2", "c2", bought=june),
            order("o3", "c3", bought=june), order("o4", "c3", "canceled", bought=june),
            order("o5", "c1", bought=DAY0.replace(year=2018)),
        ],
        customers=[
            customer("c1", "ana"), customer("c2", "ana"), customer("c3", "bob", "RJ"),
        ],
        sellers=[seller("s1"), seller("s2", "RJ")],
        products=[product("p1", "a"), product("p2", "b"), product("p3")],
        category_translation=[("a", "alpha")],
        order_items=[
            item("o1", 1, "p1", "s1", "10.00"), item("o2", 1, "p2", "s1", "30.00"),
            item("o3", 1, "p1", "s2", "60.00"), item("o4", 1, "p3", "s2", "5.00"),
            item("o5", 1, "p2", "s1", "20.00"),
        ],
        payments=[
            payment("o1"), payment("o2", 1, installments=4, value="20.00"),
            payment("o2", 2, "voucher", value="10.00"), payment("o3", 1, "boleto", value="60.00"),
        ],
        reviews=[review("r1", "o1", 1), review("r2", "o3", 5)],
    )
    return Star.of(mk, PUBLISHED)


def until(day):
    return F.col("order_purchase_date") <= F.lit(day).cast("date")


def test_repeat_status_depends_on_the_filter(star):
    names = ["completed_unique_customers", "observed_repeat_customers",
             "repeat_customer_order_share", "repeat_customer_item_sales_value"]
    early = one(ms.evaluate(star, names, where=until("2017-03-31")))
    assert (early["completed_unique_customers"], early["observed_repeat_customers"]) == (1, 0)
    all_2017 = one(ms.evaluate(star, names, where=until("2017-12-31")))
    assert all_2017["observed_repeat_customers"] == 1
    assert all_2017["repeat_customer_order_share"] == pytest.approx(2 / 3)
    assert all_2017["repeat_customer_item_sales_value"] == 40.0


def test_category_share_ignores_the_category_filter_only(star):
    chosen = F.col("category_key") == "a"
    row = one(ms.evaluate(
        star, ["category_item_sales_value", "category_marketplace_share"],
        where=until("2017-12-31"), only=chosen,
    ))
    assert row["category_item_sales_value"] == 70.0
    assert row["category_marketplace_share"] == pytest.approx(0.7)
    shares = by(ms.evaluate(star, ["category_marketplace_share"], ["category_key"]),
                "category_key")
    assert shares["a"]["category_marketplace_share"] == pytest.approx(70 / 120)
    assert shares["__unknown__"]["category_marketplace_share"] == 0.0


def test_shares_inside_groups_and_beside_the_lifted_selection(star):
    """The whole of a share follows the grouping but not the selection, for sums and for orders."""
    year = F.year("order_purchase_date").alias("year")
    rows = star["fact_payments"].withColumn("year", year)
    usage = ms.evaluate(
        Star({"fact_payments": rows}),
        ["orders_using_payment_method", "payment_method_order_usage_rate", "payment_value_share"],
        ["year", "payment_type"], only=F.col("payment_type").isin("voucher", "boleto"),
    )
    found = {r.payment_type: r.asDict() for r in usage.collect()}
    assert set(found) == {"voucher", "boleto"}
    # o2 pays by card and voucher: one of three orders, 10 of 100
    assert found["voucher"]["orders_using_payment_method"] == 1
    assert found["voucher"]["payment_method_order_usage_rate"] == pytest.approx(1 / 3)
    assert found["voucher"]["payment_value_share"] == pytest.approx(0.1)
    rows = star["fact_order_categories"].withColumn("year", F.year("order_purchase_date"))
    shares = ms.evaluate(
        Star({"fact_order_categories": rows, "dim_category": star["dim_category"]}),
        ["category_item_sales_value", "category_marketplace_share"], ["year"],
        dimensions={"dim_category": F.col("category_key") == "b"},
    )
    assert {r.year: r.category_marketplace_share for r in shares.collect()} == {
        2017: pytest.approx(0.3), 2018: 1.0,
    }
    none = ms.evaluate(star, ["payment_value_share"], ["payment_type"], only=F.lit(False))
    assert none.collect() == []


def test_ratio_of_nothing_is_null(star):
    row = one(ms.evaluate(star, ["completion_rate", "late_delivery_rate"],
                          where=F.col("order_status") == "none"))
    assert row == {"completion_rate": None, "late_delivery_rate": None}


def test_payment_measures(star):
    row = one(ms.evaluate(star, ["paid_orders", "mixed_method_orders", "multi_installment_rate",
                                 "avg_credit_card_payment_value"]))
    assert (row["paid_orders"], row["mixed_method_orders"]) == (3, 1)
    assert row["multi_installment_rate"] == 0.5
    assert row["avg_credit_card_payment_value"] == 15.0
    usage = by(ms.evaluate(star, ["payment_method_order_usage_rate", "payment_value_share"],
                           ["payment_type"]), "payment_type")
    # usage is not additive: an order may use two methods
    assert usage["credit_card"]["payment_method_order_usage_rate"] == pytest.approx(2 / 3)
    assert usage["boleto"]["payment_value_share"] == pytest.approx(0.6)


def test_dimension_slice(star):
    rows = ms.sliced(star["fact_seller_orders"], "seller_id", star["dim_seller"], "seller_id",
                     F.col("seller_state") == "RJ")
    row = one(ms.evaluate(Star({"fact_seller_orders": rows}),
                          ["active_sellers", "seller_item_sales_value"]))
    assert row == {"active_sellers": 1, "seller_item_sales_value": 60.0}


def test_matched_years(star):
    row = one(ms.matched(star, ["completed_orders", "completed_item_sales_value"], PUBLISHED))
    assert (row["completed_orders_2017"], row["completed_orders_2018"]) == (3, 1)
    assert row["completed_item_sales_value_growth_pct"] == -80.0
    rows = by(ms.category_matched(star, PUBLISHED), "category_key")
    assert rows["a"]["absolute_growth"] == -70.0
    assert rows["a"]["growth_contribution_pct"] == 87.5
    assert rows["b"]["share_change_pp"] == 70.0


def test_measures_of_two_facts_are_refused(star):
    with pytest.raises(ValueError):
        ms.evaluate(star, ["paid_orders", "active_sellers"])


def test_star_is_consistent_and_survives_publication(spark, star, tmp_path):
    star.publish(str(tmp_path / "star"))
    stored = Star.read(spark, str(tmp_path / "star"))
    for version in (star, stored):
        assert {r.status for r in star_checks.grain_checks(version).collect()} == {"PASS"}
        assert {r.status for r in star_checks.link_checks(version).collect()} == {"PASS"}
        assert one(star_checks.calendar_check(version))["status"] == "PASS"
    totals = {(r.dataset, r.metric): r.actual_value
              for r in star_checks.fact_totals(stored).collect()}
    assert totals[("fact_orders", "recorded_item_sales_value")] == 125
    assert totals[("fact_seller_orders", "completed_relationships")] == 4


def test_integrity_counts_repeated_incomplete_and_unlinked_keys(spark, star):
    sellers = star["fact_seller_orders"]
    broken = sellers.unionByName(sellers.where("order_id = 'o1'")).unionByName(
        sellers.where("order_id = 'o2'").withColumn("seller_id", F.lit(None).cast("string"))
    ).unionByName(sellers.where("order_id = 'o3'").withColumn("seller_id", F.lit("s9")))
    tables = {name: star[name] for name in facts.GRAINS}
    empty = star["fact_payments"].limit(0)
    found = star_checks.integrity(Star({**tables, "fact_seller_orders": broken, "fact_payments": empty}))
    faults = {r.subject: r.faults for r in found.collect()}
    assert faults.pop("fact_seller_orders (order_id, seller_id)") == 2
    assert faults.pop("fact_seller_orders.seller_id -> dim_seller.seller_id") == 1
    assert set(faults.values()) == {0} and len(faults) == 13
    grain = by(star_checks.grain_checks(Star({**tables, "fact_payments": empty})), "dataset")
    assert grain["fact_payments"]["total_rows"] == 0 and grain["fact_payments"]["status"] == "PASS"


def test_cross_fact_check_sees_a_fact_that_lost_rows(spark, sf_dir):
    star = facts.Star.of(bindings.bind(spark, sf_dir), bindings.PERIODS)
    names = ("fact_orders", "fact_order_categories", "fact_seller_orders")
    whole = {name: star[name] for name in names}
    assert {r.status for r in star_checks.cross_fact_check(facts.Star(whole)).collect()} == {"PASS"}
    whole["fact_seller_orders"] = star["fact_seller_orders"].filter("seller_item_count > 1")
    assert "FAIL" in {r.status for r in star_checks.cross_fact_check(facts.Star(whole)).collect()}


def test_measures_agree_with_the_reports_unless_a_fact_lost_rows(spark, sf_dir, tmp_path):
    mk = bindings.bind(spark, sf_dir)
    chosen = [x for x in measure_checks.COMPARISONS if x.area in ("sellers", "payment method")]
    star = facts.Star.of(mk, bindings.PERIODS)
    rows = measure_checks.reconciliation(mk, star, bindings.PERIODS, chosen).collect()
    assert {r.status for r in rows} == {"PASS"} and len(rows) == 4 + 4 * 3
    lost = facts.Star({
        "fact_seller_orders": star["fact_seller_orders"].where("seller_item_count > 1"),
        "fact_payments": star["fact_payments"].where("payment_type <> 'voucher'"),
    })
    rows = measure_checks.reconciliation(mk, lost, bindings.PERIODS, chosen).collect()
    failed = {(r.area, r.member) for r in rows if r.status == "FAIL"}
    assert ("sellers", "all") in failed and ("payment method", "voucher") in failed
    missing = [r for r in rows if r.member == "voucher"]
    assert {r.measure_value for r in missing} == {0.0} and {r.status for r in missing} == {"FAIL"}
