"""Small literal marketplaces for edge cases."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from bazaarscope.sources.model import SCHEMAS, Marketplace

DAY0 = datetime(2017, 3, 1, 12, 0, 0)


def at(days: float = 0, seconds: int = 0) -> datetime:
    return DAY0 + timedelta(days=days, seconds=seconds)


def order(order_id, customer="c1", status="delivered", bought=DAY0, delivered=None,
          estimated=None, approved=None, carrier=None):
    estimated = estimated or bought + timedelta(days=10)
    return (order_id, customer, status, bought, approved, carrier, delivered, estimated)


def item(order_id, n=1, product="p1", seller="s1", price="10.00", freight="1.00", limit=DAY0):
    return (order_id, n, product, seller, limit, Decimal(price), Decimal(freight))


def payment(order_id, n=1, kind="credit_card", installments=1, value="10.00"):
    return (order_id, n, kind, installments, Decimal(value))


def review(review_id, order_id, score=5, answered=DAY0, created=DAY0, title=None, message=None):
    return (review_id, order_id, score, title, message, created, answered)


def product(product_id, category=None, weight=100):
    return (product_id, category, 10, 100, 1, weight, 10, 10, 10)


def customer(customer_id, person=None, state="SP", zip_prefix="01000"):
    return (customer_id, person or customer_id, zip_prefix, "sao paulo", state)


def seller(seller_id, state="SP"):
    return (seller_id, "01000", "sao paulo", state)


def market(spark, **rows) -> Marketplace:
    """Tables not given are empty."""

    def build(table):
        return lambda: spark.createDataFrame(rows.get(table, []), SCHEMAS[table])

    unknown = set(rows) - set(SCHEMAS)
    assert not unknown, unknown
    return Marketplace({table: build(table) for table in SCHEMAS})


def one(df):
    return df.collect()[0].asDict()


def by(df, key):
    return {row[key]: row.asDict() for row in df.collect()}
