"""Shapes the physical plans must keep."""

import re
from collections import Counter

import pytest

import __spark_entry__ as entry_points
from bazaarscope.plans import cleaning, quality_counts
from bazaarscope.sources import bindings
from bazaarscope.sources.model import Marketplace

NAMES = [
    *entry_points._reports(), "fact_orders", "fact_order_categories", "fact_seller_orders",
    "fact_payments", *entry_points._measures(), "audit_numeric_profile", "audit_cardinality",
    "star_link_checks", "star_grain_checks", "star_integrity",
]


def plan_of(spark, name, sf_dir):
    df = entry_points.queries()[name](spark, sf_dir)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_and_no_python(spark, sf_dir, no_broadcast, name):
    """Without automatic broadcasts every join is a sort-merge join on keys."""
    plan = plan_of(spark, name, sf_dir)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BroadcastExchange" not in plan
    for python_node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert python_node not in plan


# windows over a whole result may follow only an aggregate on these few-valued columns
DOMAINS = {
    "order_status", "order_year", "customer_type", "customer_state", "seller_state",
    "completed_orders", "source_category_name", "payment_type", "payment_method_combination",
    "payment_installments", "installment_group", "tile", "_bucket", "entity_type",
    "category_name",
}


def test_windows_without_partition_follow_small_aggregates(spark, sf_dir):
    """The row that feeds a global window is grouped by a domain column or a bucket."""
    for name in entry_points._reports():
        lines = plan_of(spark, name, sf_dir).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" not in line:
                continue
            below = "\n".join(lines[i + 1:])
            keys = re.search(r"HashAggregate\(keys=\[([^\]]*)\]", below)
            limited = re.search(r"_local_rank#\d+L? <= ", below)
            if keys is None:
                continue  # a plain aggregate to one row
            names = {k.split("#")[0].strip() for k in keys.group(1).split(",") if k.strip()}
            partial = not names  # global aggregate: one row per task arrives here
            assert partial or names & DOMAINS or limited or is_sorted_label(names), (name, names)


def is_sorted_label(names):
    return any(n.startswith(("_groupingexpression", "installment", "delay")) for n in names)


def test_period_filter_and_columns_reach_the_scan(spark, sf_dir):
    df = entry_points.queries()["monthly_trends"](spark, sf_dir)
    text = df._jdf.queryExecution().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line]
    scan = [line for line in scans if "o_orderdate" in line][-1]
    assert "GreaterThanOrEqual(o_orderdate" in scan
    assert "o_totalprice" not in scan
    items = [line for line in scans if "l_orderkey" in line][-1]
    assert "l_shipdate" not in items and "l_tax" not in items


def test_upstream_shuffle_is_shared(spark, sf_dir):
    """Both branches of the running totals reuse one scan and shuffle of the items."""
    df = entry_points.queries()["product_concentration"](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1


@pytest.mark.parametrize("name", [
    "payment_population", "payment_method_mix", "payments_by_month_and_method", "fact_payments",
])
def test_payments_are_counted_without_object_aggregates(spark, sf_dir, name):
    assert "ObjectHashAggregate" not in plan_of(spark, name, sf_dir)


@pytest.mark.parametrize("name", ["measures_payments", "measures_payment_methods_all"])
def test_paid_orders_are_counted_without_expanding_rows(spark, sf_dir, name):
    assert "Expand" not in plan_of(spark, name, sf_dir)


def test_shares_and_their_wholes_come_from_one_pass_over_the_fact(spark, sf_dir):
    """A share reads no more files than its fact."""
    for name, fact in (
        ("measures_payment_methods", "fact_payments"),
        ("measures_payment_methods_all", "fact_payments"),
        ("measures_categories", "fact_order_categories"),
        ("measures_category_matched", "fact_order_categories"),
    ):
        scans = [plan_of(spark, x, sf_dir).count("FileScan") for x in (name, fact)]
        assert scans[0] <= scans[1], (name, scans)


@pytest.mark.parametrize("name", ["star_link_checks", "star_grain_checks", "star_integrity"])
def test_star_checks_read_every_table_once(spark, sf_dir, name):
    whole = sum(
        plan_of(spark, table, sf_dir).count("FileScan")
        for table in entry_points.facts.GRAINS
    )
    plan = plan_of(spark, name, sf_dir)
    assert plan.count("FileScan") <= whole
    assert "Expand" not in plan


@pytest.mark.parametrize("name", ["top_products", "top_sellers"])
def test_leading_rows_are_kept_per_task(spark, sf_dir, name):
    plan = plan_of(spark, name, sf_dir)
    assert "TakeOrderedAndProject" in plan or "LocalLimit" in plan
    assert "_bucket" not in plan


def test_quality_counts_read_a_table_three_times_at_most(spark, sf_dir, tmp_path):
    """Once as text, once cleaned, and orders, items and reviews once for rules beside the order."""
    for table, df in bindings.bind_raw(spark, sf_dir).items():
        df.write.parquet(str(tmp_path / table))
    raw = Marketplace({t: spark.read.parquet(str(tmp_path / t)) for t in bindings.SCHEMAS})
    found = quality_counts.tallied(raw, cleaning.clean(raw), bindings.SHIPPING_LIMIT_FROM)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = Counter(m.rsplit("/", 1)[1] for m in re.findall(r"FileScan parquet [^\n]*?Location: \w+\([^)]*\)\[([^\],]*)", plan))
    assert set(scans) <= set(bindings.SCHEMAS) and len(scans) == 9
    assert max(scans.values()) <= 3, scans
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
