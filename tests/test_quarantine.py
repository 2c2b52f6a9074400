"""Rows split off while cleaning: addresses, rules, counts, mending."""

import pytest

from bazaarscope.plans import cleaning, quality_counts, quarantine
from bazaarscope.sources import bindings
from bazaarscope.sources.model import SCHEMAS, Marketplace
from bazaarscope.sources.raw_csv import raw_columns

ORDERS = [
    ("o1", "c1", "delivered", "2017-01-01 10:00:00", None, None, None, "2017-02-01 00:00:00"),
    ("o2", "c1", "delivered", "2017-01-32 10:00:00", None, None, None, "2017-02-01 00:00:00"),
    (None, "c2", "delivered", "2017-01-01 10:00:00", "2016-12-31 09:00:00", None, None, "2017-02-01 00:00:00"),
    ("o4", "c2", "  ", "2017-01-01 10:00:00", None, "soon", None, "2017-02-01 00:00:00"),
    ("o5", "c2", "shipped", "2017-01-01 10:00:00", None, None, None, "2017-02-01 00:00:00"),
]


@pytest.fixture
def raw(spark, tmp_path):
    ddl = ", ".join(f"{x} string" for x in raw_columns("orders"))
    spark.createDataFrame(ORDERS, ddl).coalesce(1).write.parquet(str(tmp_path / "orders"))

    def build(table):
        if table == "orders":
            return lambda: spark.read.parquet(str(tmp_path / "orders"))
        return lambda: spark.createDataFrame([], ", ".join(f"{x} string" for x in raw_columns(table)))

    return Marketplace({t: build(t) for t in SCHEMAS})


@pytest.fixture
def watch(spark):
    return quarantine.watched("orders")


def test_rows_and_rules(raw, watch):
    both = quarantine.split(raw, "orders", watch)
    assert sorted(r.order_id for r in both.clean.collect()) == ["o1", "o5"]
    assert both.clean.schema == cleaning.clean_table(raw, "orders").schema
    rows = {r.row: list(r.rules) for r in both.broken.collect()}
    assert rows == {
        "1": ["order_purchase_timestamp does not convert"],
        "2": ["order_id IS NULL", "order_approved_at < order_purchase_timestamp"],
        "3": ["order_status IS NULL", "order_delivered_carrier_date does not convert"],
    }


def test_both_parts_are_written_in_one_pass(raw, tmp_path, watch):
    both = quarantine.write_split(raw, "orders", str(tmp_path / "split"), watch)
    assert both.clean.count() == 2 and both.broken.count() == 3
    counts = {r.rule: r.rows for r in quarantine.rule_counts([both.broken]).collect()}
    assert counts["order_id IS NULL"] == 1 and sum(counts.values()) == 5


def test_a_mended_row_is_replayed(spark, raw, watch):
    broken = quarantine.split(raw, "orders", watch).broken
    file = broken.first().file
    fixes = spark.createDataFrame([
        (file, "1", "order_purchase_timestamp", "2017-01-02 10:00:00"),
        (file, "3", "order_delivered_carrier_date", None),
    ], quarantine.FIXES)
    again = quarantine.replay("orders", broken, fixes, watch)
    assert [r.order_id for r in again.clean.collect()] == ["o2"]
    assert {r.row: list(r.rules) for r in again.broken.collect()} == {
        "2": ["order_id IS NULL", "order_approved_at < order_purchase_timestamp"], "3": ["order_status IS NULL"],
    }


def test_counts_equal_those_of_the_register(spark, sf_dir):
    raw = bindings.bind_raw(spark, sf_dir)
    tables = ("orders", "order_items", "payments", "products")
    limit = bindings.SHIPPING_LIMIT_FROM
    parts = [quarantine.split(raw, t, quarantine.watched(t, limit)).broken for t in tables]
    found = {(r.table_name, r.rule): r.rows for r in quarantine.rule_counts(parts).collect()}
    counts = quality_counts.counts(raw, cleaning.clean(raw), limit)
    known = {(r.topic, r.item): r.n for r in counts.where("statistic = 'rows'").collect()}
    assert len(found) >= 5
    for (table, rule), n in found.items():
        topic = quality_counts.BESIDE_ORDERS if rule.startswith("shipping") else table
        assert known[topic, rule] == n
