"""Incremental refresh of the published star.

Facts are stored by purchase month, and a manifest names the folder that holds each month of each
fact. A refresh finds the orders that changed rows reach, of whatever table, rebuilds only the
months these orders were or are in, and publishes one manifest for all facts and dimensions.
Readers see a refresh whole or not at all; one that dies is started again under its name.

Changed rows are found by digests of the columns that facts use, so a change of a product's weight
rebuilds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bazaarscope.functions.periods import Periods
from bazaarscope.operators.profile import union_all
from bazaarscope.operators.tally import digest
from bazaarscope.plans.facts import GRAINS, PURCHASE, Star
from bazaarscope.sources import versions
from bazaarscope.sources.model import Marketplace

c = F.col
MONTH = "purchase_month"
NO_MONTH = "none"  # orders without a purchase date
FACTS = tuple(name for name in GRAINS if name.startswith("fact_"))
DIMENSIONS = tuple(name for name in GRAINS if not name.startswith("fact_"))

# what the facts read of each table, the key that leads to orders first
_USED = {
    "orders": ("order_id", "customer_id", "order_status", PURCHASE,
               "order_delivered_customer_date", "order_estimated_delivery_date"),
    "order_items": ("order_id", "order_item_id", "product_id", "seller_id", "price"),
    "payments": ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"),
    "reviews": ("order_id", "review_id", "review_score", "review_answer_timestamp"),
    "customers": ("customer_id", "customer_unique_id", "customer_state"),
    "products": ("product_id", "product_category_name"),
    "category_translation": ("product_category_name", "product_category_name_english"),
}


# -- what changed --------------------------------------------------------------------------
def changed_keys(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of the first column whose rows differ, as multisets, between both states.

    Rows travel as a key and 128 bits, and equal ones meet on the map side.
    """
    key = columns[0]

    def marked(rows: DataFrame, sign: int) -> DataFrame:
        first, second = digest([c(name) for name in columns])
        return rows.select(c(key), first.alias("a"), second.alias("b"), F.lit(sign).alias("s"))

    rows = marked(before, -1).unionAll(marked(after, 1))
    differing = rows.groupBy(key, "a", "b").agg(F.sum("s").alias("s")).where("s <> 0")
    return differing.where(c(key).isNotNull()).select(key).distinct()


def affected_orders(before: Marketplace, after: Marketplace) -> DataFrame:
    """``order_id`` of the orders, old or new, that any changed row reaches."""
    changed = {t: changed_keys(before[t], after[t], columns) for t, columns in _USED.items()}

    def of_both(table: str, keys: Sequence[str]) -> DataFrame:
        return before[table].select(*keys).unionAll(after[table].select(*keys))

    # names reach products, products reach items, items and customers reach orders
    renamed = of_both("products", ["product_id", "product_category_name"]).join(
        changed["category_translation"], "product_category_name", "left_semi"
    )
    products = changed["products"].unionAll(renamed.select("product_id")).distinct()
    by_product = of_both("order_items", ["order_id", "product_id"]).join(products, "product_id", "left_semi")
    by_customer = of_both("orders", ["order_id", "customer_id"]).join(
        changed["customers"], "customer_id", "left_semi"
    )
    direct = [changed[t] for t in ("orders", "order_items", "payments", "reviews")]
    return union_all([*direct, by_product.select("order_id"), by_customer.select("order_id")]).distinct()


def _month(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(NO_MONTH))


def affected_months(before: Marketplace, after: Marketplace) -> list[str]:
    """The months that affected orders were or are in; as many at most as the calendar has."""
    dated = before.orders.select("order_id", PURCHASE).unionAll(after.orders.select("order_id", PURCHASE))
    reached = dated.join(affected_orders(before, after), "order_id", "left_semi")
    return sorted(r[0] for r in reached.select(_month(c(PURCHASE))).distinct().collect())


# -- the part to rebuild -------------------------------------------------------------------
def _in_months(months: Sequence[str]) -> Column:
    """A test on the purchase time that scans can use: one range for each stretch of months."""
    test = c(PURCHASE).isNull() if NO_MONTH in months else F.lit(False)
    stretches: list[list[int]] = []
    for year, month in (m.split("-") for m in months if m != NO_MONTH):
        number = int(year) * 12 + int(month) - 1
        if stretches and stretches[-1][1] == number:
            stretches[-1][1] += 1
        else:
            stretches.append([number, number + 1])
    for first, end in stretches:
        low, high = (F.lit(f"{n // 12:04d}-{n % 12 + 1:02d}-01").cast("timestamp_ntz") for n in (first, end))
        test = test | ((c(PURCHASE) >= low) & (c(PURCHASE) < high))
    return test


def restricted(mk: Marketplace, months: Sequence[str]) -> Marketplace:
    """Only orders of these months, and of the tables below orders only their rows."""
    orders = mk.orders.where(_in_months(months))
    ids = orders.select("order_id")
    below = {t: mk[t].join(ids, "order_id", "left_semi") for t in ("order_items", "payments", "reviews")}
    return mk.replaced(orders=orders, **below)


# -- publication ---------------------------------------------------------------------------
EMPTY = {"version": 0, "refreshes": [], "months": {f: {} for f in FACTS}, "schemas": {}, "dimensions": {}}


def current(spark: SparkSession, folder: str) -> dict:
    """The manifest in force; ``EMPTY`` before the first build."""
    found = versions.current(spark, folder)
    return found if found["version"] else EMPTY


def _stored_months(spark: SparkSession, path: str) -> list[str]:
    fs, target = versions._fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return [n.split("=", 1)[1] for n in names if n.startswith(f"{MONTH}=")]


def refresh(
    before: Marketplace | None, after: Marketplace, periods: Periods, spark: SparkSession, folder: str, name: str
) -> dict:
    """Bring the star in ``folder`` from the state ``before`` to ``after``; the manifest in force.

    The star must have been brought to ``before`` by an earlier call. Without ``before`` everything
    is built. A refresh that was published under this name is not repeated.
    """
    folder = folder.rstrip("/")
    old = current(spark, folder)
    if name in old["refreshes"]:
        return old
    if before is not None and not old["version"]:
        raise ValueError(f"nothing is published in {folder} that could be refreshed")
    months = None if before is None else affected_months(before, after)
    star = Star.of(after if months is None else restricted(after, months), periods)
    schemas, stored = {}, {}
    for fact in FACTS:
        kept = {} if months is None else {m: p for m, p in old["months"][fact].items() if m not in months}
        schemas[fact] = star[fact].schema.json()
        path = f"data/{name}/{fact}"
        if months is None or months:
            # the order id is part of the range, so that a large month is spread over files
            keys = (MONTH, "order_purchase_date", "order_id")
            rows = star[fact].withColumn(MONTH, _month(c("order_purchase_date")))
            rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
            rows.write.mode("overwrite").partitionBy(MONTH).parquet(f"{folder}/{path}")
            kept.update({m: f"{path}/{MONTH}={m}" for m in _stored_months(spark, f"{folder}/{path}")})
        stored[fact] = kept
    whole = Star.of(after, periods)
    for dimension in DIMENSIONS:
        whole[dimension].write.mode("overwrite").parquet(f"{folder}/data/{name}/{dimension}")
    manifest = {
        "version": old["version"] + 1,
        "refreshes": [*old["refreshes"], name],
        "months": stored,
        "schemas": schemas,
        "dimensions": {d: f"data/{name}/{d}" for d in DIMENSIONS},
    }
    versions._write_json(spark, versions._manifest_path(folder, manifest["version"]), manifest)
    return manifest


def read(spark: SparkSession, folder: str) -> Star:
    """The star as the manifest in force has it."""
    folder = folder.rstrip("/")
    manifest = current(spark, folder)
    if not manifest["version"]:
        raise ValueError(f"nothing is published in {folder}")

    def fact(name: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schemas"][name]))
        paths = [f"{folder}/{p}" for p in manifest["months"][name].values()]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    tables = {name: (lambda name=name: fact(name)) for name in FACTS}
    for name, path in manifest["dimensions"].items():
        tables[name] = lambda path=path: spark.read.parquet(f"{folder}/{path}")
    return Star(tables)
