"""All counts that the validation register and the audit findings need, from one plan.

A raw table is read once, a cleaned table once, and items, reviews and their orders once more for
the rules that compare a row with its order. Everything else is arithmetic on a table of
counts with a few hundred rows, which is stored and read by register, summary, readiness gate
and findings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarscope.functions import domain as D
from bazaarscope.functions import metrics as M
from bazaarscope.operators import tally
from bazaarscope.operators.ordered import decimal_key, quantiles
from bazaarscope.operators.tally import Key, Source, Tally
from bazaarscope.plans import audit as A
from bazaarscope.plans import cleaning as C
from bazaarscope.session import scratch_path
from bazaarscope.sources.model import SCHEMAS, TABLES, Marketplace

c = F.col

# (topic of the key, slot) of columns that several tables share; slot 0 is referred to
SHARED_KEYS: dict[str, list[tuple[str, str, int]]] = {
    "customers": [("customer_id", "customer_id", 0), ("zip", "customer_zip_code_prefix", 1)],
    "orders": [("order_id", "order_id", 0), ("customer_id", "customer_id", 1)],
    "order_items": [("order_id", "order_id", 1), ("product_id", "product_id", 1), ("seller_id", "seller_id", 1)],
    "payments": [("order_id", "order_id", 2)],
    "reviews": [("order_id", "order_id", 3)],
    "products": [("product_id", "product_id", 0), ("category", "product_category_name", 1)],
    "sellers": [("seller_id", "seller_id", 0), ("zip", "seller_zip_code_prefix", 2)],
    "geolocation": [("zip", "geolocation_zip_code_prefix", 0)],
    "category_translation": [("category", "product_category_name", 0)],
}
OWN_IDS = {"customers": "customer_unique_id", "reviews": "review_id"}
DOMAINS = {"orders": ("order_status", D.ORDER_STATUSES), "payments": ("payment_type", D.PAYMENT_TYPES)}


def slot_of(table: str, column: str) -> tuple[str, int]:
    """Topic and slot under which a table's column is counted."""
    return next((topic, slot) for topic, name, slot in SHARED_KEYS[table] if name == column)


def raw_topic(table: str) -> str:
    return f"raw {table}"


def null_rule(column: str) -> str:
    return f"{column} IS NULL"


def text_labels(column: str) -> list[str]:
    return [f"{column} = ''", f"{column} is blank", f"{column} is padded"]


def _text_rule(column: str, name: str | None = None) -> tuple[tuple[str, ...], Column]:
    """Missing, empty, blank and padded as one case; what is blank is padded too."""
    label = name or column
    return (null_rule(label), *text_labels(label)), M.untidiness(c(column), null=1, empty=2, blank=12, padded=8)


def failed_rule(column: str) -> str:
    return f"{column} does not convert"


def _raw_source(raw: Marketplace, table: str) -> Source:
    """A raw table: missing, untidy and inconvertible cells, copies of rows."""
    spelt = {f.name: name for f, name in zip(SCHEMAS[table].fields, raw[table].columns, strict=True)}
    rows = C._renamed(raw, table)
    rules = []
    for field in SCHEMAS[table].fields:
        rules.append(_text_rule(field.name, spelt[field.name]))
        if C._may_fail(table, field):
            failed = c(field.name).isNotNull() & C._parsed(table, field).isNull()
            rules.append((failed_rule(field.name), failed))
    keys = [Key(f"copies of {raw_topic(table)}", [c(x) for x in rows.columns])]
    if table == "geolocation":
        # rows that cleaning takes for copies: equal after conversion
        typed = [C._parsed(table, f) for f in SCHEMAS[table].fields]
        keys.append(Key(f"typed copies of {raw_topic(table)}", typed))
    return Source(raw_topic(table), rows, rules, keys)


def incomplete_rule(table: str) -> str:
    return f"key of {table} holds NULL"


def state_rules(table: str, states: Sequence[str]) -> list[tuple[str, Column]]:
    code = F.upper(M.stripped(c(D.STATE_COLUMNS[table])))
    return [("state code missing", code.isNull()), ("state code unknown", ~code.isin(*states))]


def clean_rules(table: str, states: Sequence[str]) -> list[tuple[str, Column]]:
    """Everything that is looked at on single rows of a cleaned table."""
    rules = [(null_rule(f.name), c(f.name).isNull()) for f in SCHEMAS[table].fields]
    if table in D.PRIMARY_KEYS:
        holds_null = F.greatest(*(c(k).isNull() for k in D.PRIMARY_KEYS[table]), F.lit(False))
        rules.append((incomplete_rule(table), holds_null))
    rules += C.tidy_rules(table)
    rules += A.domain_rules().get(table, [])
    rules += [r for r in A.audit_rules().get(table, []) if r[0] not in dict(rules)]
    rules += A.order_timeline_rules() if table == "orders" else []
    rules += state_rules(table, states) if table in D.STATE_COLUMNS else []
    if table in D.CITY_COLUMNS:
        rules.append(("numeric city", c(D.CITY_COLUMNS[table]).rlike("^[0-9]+$")))
    if table in DOMAINS:
        column, allowed = DOMAINS[table]
        rules.append((f"{column} outside its domain", ~c(column).isin(*allowed)))
    if table == "payments":
        rules.append(("payment_type = not_defined", c("payment_type") == "not_defined"))
    return rules


def _clean_source(mk: Marketplace, table: str, states: Sequence[str]) -> Source:
    rows = mk[table]
    keys = [Key(topic, [c(name)], slot, skip_null=slot > 0) for topic, name, slot in SHARED_KEYS[table]]
    own = D.PRIMARY_KEYS.get(table, ())
    if len(own) > 1:
        keys.append(Key(f"key of {table}", [c(k) for k in own]))
    if table in OWN_IDS:
        keys.append(Key(OWN_IDS[table], [c(OWN_IDS[table])]))
    keys.append(Key(f"copies of {table}", [c(x) for x in rows.columns]))
    if table in DOMAINS:
        column, allowed = DOMAINS[table]
        keys.append(Key(f"values of {column}", [c(column)], where=~c(column).isin(*allowed)))
    values = [(f"{table}.{name}", c(name)) for name in D.OUTLIER_COLUMNS.get(table, ())]
    return Source(table, rows, clean_rules(table, states), keys, values)


BESIDE_ORDERS = "rows beside their orders"


def _beside_orders(mk: Marketplace, shipping_limit_from: str) -> Source:
    """Rules that compare items and reviews with their order, in one join.

    Limits are compared through their distinct values. The rules of one table are unknown, so
    not met, on rows of the other.
    """
    limits = mk.order_items.groupBy("order_id", "shipping_limit_date").agg(F.count("*").alias("n"))
    sent = mk.reviews.select("order_id", "review_creation_date", "review_answer_timestamp", F.lit(1).alias("n"))
    orders = mk.orders.select(
        "order_id", "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"
    )
    rows = limits.unionByName(sent, allowMissingColumns=True).join(orders, "order_id", "left")
    rules = A.shipping_rules(shipping_limit_from) + A.review_rules()
    return Source(BESIDE_ORDERS, rows, rules, weight=c("n"))


def _outliers(summary: DataFrame) -> DataFrame:
    """``topic, item, statistic, n``: rows outside the quartiles by 1.5 times their distance."""
    present = tally.histogram(summary)
    spread = c("q3") - c("q1")
    bounds = quantiles(
        present, "value", decimal_key(c("value")), linear={"q1": 25, "q3": 75}, by=["topic"]
    ).select("topic", (c("q1") - 1.5 * spread).alias("low"), (c("q3") + 1.5 * spread).alias("high"))
    outside = (c("value") < c("low")) | (c("value") > c("high"))
    # one row of bounds per column of a fixed list, so the broadcast side is bounded
    flagged = present.join(F.broadcast(bounds), "topic").groupBy("topic").agg(
        F.coalesce(F.sum(F.when(outside, c("n"))), F.lit(0)).alias("n")
    )
    return flagged.select("topic", F.lit("*").alias("item"), F.lit("outliers").alias("statistic"), "n")


def tallied(
    raw: Marketplace,
    cleaned: Marketplace,
    shipping_limit_from: str = "2019-01-01",
    states: Sequence[str] = D.STATE_CODES,
) -> DataFrame:
    """The summary of all sources; a table has to be made of it before it is read."""
    return Tally([
        *(_raw_source(raw, table) for table in TABLES),
        *(_clean_source(cleaned, table, states) for table in TABLES),
        _beside_orders(cleaned, shipping_limit_from),
    ]).summary()


def store(summary: DataFrame, folder: str) -> DataFrame:
    """Write the summary, and from it the counts that all reports read; return the counts."""
    spark = summary.sparkSession
    summary.write.mode("errorifexists").parquet(f"{folder}/summary")
    found = spark.read.schema(summary.schema).parquet(f"{folder}/summary")
    rows = tally.counts(found).unionByName(_outliers(found))
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/counts")
    return read(spark, folder)


_COUNTS = "topic string, item string, statistic string, n bigint"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``topic, item, statistic, n`` of everything the reports need, as stored."""
    return spark.read.schema(_COUNTS).parquet(f"{folder}/counts")


def counts(
    raw: Marketplace,
    cleaned: Marketplace,
    shipping_limit_from: str = "2019-01-01",
    states: Sequence[str] = D.STATE_CODES,
) -> DataFrame:
    """The counts, stored in the shared scratch folder."""
    found = tallied(raw, cleaned, shipping_limit_from, states)
    return store(found, scratch_path(found.sparkSession, "quality"))
