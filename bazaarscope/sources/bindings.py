"""Binds the supplied Parquet tables to the roles of the marketplace model.

``bind`` yields the cleaned layer, ``bind_raw`` the same tables as untidy text, as the raw
files would hold them, so that the cleaning plans can run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarscope.functions import domain as D
from bazaarscope.functions.periods import january_to_august
from bazaarscope.sources.model import SCHEMAS, Marketplace
from bazaarscope.sources.raw_csv import raw_columns

PERIODS = january_to_august(1996)
SHIPPING_LIMIT_FROM = "2001-01-01"
_STATUS = {"F": "delivered", "O": "shipped", "P": "canceled"}
_PAYMENT = {"R": "credit_card", "A": "boleto", "N": "voucher"}


def _mapped(column: str, values: dict[str, str]) -> Column:
    expr = None
    for source, target in values.items():
        test = F.col(column) == source
        expr = F.when(test, target) if expr is None else expr.when(test, target)
    return expr


def _plus(ts: Column, hours: str) -> Column:
    return ts + F.expr(f"make_dt_interval(0, {hours}, 0, 0)")


def _text(sql: str) -> Column:
    return F.expr(f"cast({sql} as string)")


def _orders(t) -> DataFrame:
    purchase = F.col("o_orderdate")
    estimated = purchase + F.expr("interval 60 days")
    return t("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _mapped("o_orderstatus", _STATUS).alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        F.expr("if(o_orderkey % 97 = 0, null, o_orderdate + make_dt_interval(0, "
               "cast(o_orderkey % 40 as int) - 1, 0, 0))").alias("order_approved_at"),
        F.expr("if(o_orderkey % 75 = 0, null, o_orderdate + make_dt_interval(0, "
               "cast(o_orderkey * 31 % 400 as int) - 2, 0, 0))").alias(
            "order_delivered_carrier_date"),
        F.when(
            F.expr("o_orderkey % 50 <> 0"),
            _plus(estimated, "cast((o_orderkey * 7919) % 2000 as int) - 1100"),
        ).alias("order_delivered_customer_date"),
        estimated.alias("order_estimated_delivery_date"),
    )


def _order_items(t) -> DataFrame:
    # The files hold money as doubles with two digits; the plans sum it in whole cents.
    # Freight in exact integers: price cents times tax percent, rounded half up.
    freight = (
        "(cast(rint(l_extendedprice * 100) as bigint) * cast(rint(l_tax * 100) as bigint)"
        " + 50) div 100"
    )
    return t("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        F.expr(f"({freight}) / 100").alias("freight_value"),
    )


def _customers(t) -> DataFrame:
    nation = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t("customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("customer_id"),
        F.expr("if(c_custkey % 10 = 1, c_custkey - 1, c_custkey)").alias("customer_unique_id"),
        F.expr("lpad(cast(c_custkey * 37 % 1200 as string), 5, '0')").alias(
            "customer_zip_code_prefix"),
        F.lower("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def _sellers(t) -> DataFrame:
    nation = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t("supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("seller_id"),
        F.expr("lpad(cast(s_suppkey * 53 % 1200 as string), 5, '0')").alias(
            "seller_zip_code_prefix"),
        F.expr("if(s_suppkey % 17 = 0, cast(s_suppkey as string), "
               "concat('city ', s_nationkey))").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def _products(t) -> DataFrame:
    def measured(sql: str) -> Column:
        return F.expr(f"if(p_partkey % 50 = 0, null, cast({sql} as int))")

    return t("part").select(
        F.col("p_partkey").alias("product_id"),
        F.expr("if(p_brand = 'Brand#1', null, p_type)").alias("product_category_name"),
        F.expr("if(p_brand = 'Brand#1', null, length(p_name))").alias("product_name_length"),
        F.expr("if(p_brand = 'Brand#1', null, length(p_name) * p_size)").alias(
            "product_description_length"),
        F.expr("if(p_brand = 'Brand#1', null, p_size % 6)").alias("product_photos_qty"),
        measured("if(p_size % 25 = 0, 0, p_size * 150)").alias("product_weight_g"),
        measured("p_size + 10").alias("product_length_cm"),
        measured("p_size * p_size % 90 + 2").alias("product_height_cm"),
        measured("p_partkey % 60 + 6").alias("product_width_cm"),
    )


def _payments(t) -> DataFrame:
    return t("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        _mapped("l_returnflag", _PAYMENT).alias("payment_type"),
        F.expr("cast(l_quantity as int) % 14").alias("payment_installments"),
        F.col("l_extendedprice").alias("payment_value"),
    )


def _reviews(t) -> DataFrame:
    return t("events").select(
        F.col("event_id").alias("review_id"),
        F.expr("(event_id div 2) * 3").alias("order_id"),
        F.expr("1 + cast(floor(value) as int) % 5").alias("review_score"),
        F.expr("if(event_id % 3 = 0, event_type, null)").alias("review_comment_title"),
        F.expr("if(event_id % 2 = 0, props, null)").alias("review_comment_message"),
        F.expr("date_trunc('DAY', ts) + make_dt_interval(cast(event_id % 9 as int) - 7)").cast(
            "timestamp_ntz").alias("review_creation_date"),
        F.expr("date_trunc('SECOND', ts)").cast("timestamp_ntz").alias("review_answer_timestamp"),
    )


def _geolocation(t, deduplicated: bool) -> DataFrame:
    nation = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    places = (
        t("customer")
        .join(nation, "c_nationkey")
        .select(
            "c_custkey",
            # every eighth place lies elsewhere, so some prefixes of the customers are not covered
            F.expr("lpad(cast(c_custkey * 37 % 1200 + if(c_custkey % 8 = 0, 5000, 0) as string), "
                   "5, '0')").alias("geolocation_zip_code_prefix"),
            F.expr("cast(-(c_custkey % 33) as double)").alias("geolocation_lat"),
            F.expr("cast(-(c_custkey % 70) as double) - 0.5D").alias("geolocation_lng"),
            F.lower("c_mktsegment").alias("geolocation_city"),
            F.col("n_name").alias("geolocation_state"),
        )
    )
    copies = places.filter("c_custkey % 5 = 0")
    observed = places.unionByName(copies).drop("c_custkey")
    return observed.dropDuplicates() if deduplicated else observed


def _translation(t) -> DataFrame:
    """A lookup of the part types, without one of them and with one that no part has."""
    sources = t("part").filter("p_type <> 'PROMO'").select(
        F.explode(F.array("p_type", F.lit("UNUSED"))).alias("product_category_name")
    ).distinct()
    return sources.withColumn(
        "product_category_name_english",
        F.concat(F.lower("product_category_name"), F.lit("_goods")),
    )


# Declared, so that opening a file starts no job to infer its schema.
_FILES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, "
    "l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "nation": "n_nationkey int, n_name string",
    "events": "event_id bigint, ts timestamp_ntz, event_type string, value double, props string",
}


class _Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.schema(_FILES[name]).parquet(f"{self.folder}/{name}.parquet")


def fingerprint(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and times of the files that the tables are read from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in _FILES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(conf)
        for status in [fs.getFileStatus(path), *fs.listStatus(path)]:
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(out)


def bind(spark: SparkSession, folder: str) -> Marketplace:
    """The cleaned marketplace. Ids keep the integer type of the files."""
    t = _Tables(spark, folder)
    return Marketplace(
        {
            "customers": lambda: _customers(t),
            "orders": lambda: _orders(t),
            "order_items": lambda: _order_items(t),
            "payments": lambda: _payments(t),
            "reviews": lambda: _reviews(t),
            "products": lambda: _products(t),
            "sellers": lambda: _sellers(t),
            "geolocation": lambda: _geolocation(t, deduplicated=True),
            "category_translation": lambda: _translation(t),
        }
    )


# -- raw layer ---------------------------------------------------------------------
def _raw_text(df: DataFrame, table: str, special: dict[str, Column]) -> DataFrame:
    """Every column as text under its source spelling."""
    columns = []
    for field, raw in zip(SCHEMAS[table].fields, raw_columns(table), strict=True):
        if field.name in special:
            value = special[field.name]
        elif field.dataType.typeName() == "timestamp_ntz":
            value = F.date_format(field.name, D.TIMESTAMP_FORMAT)
        else:
            value = F.col(field.name).cast("string")
        columns.append(value.alias(raw))
    return df.select(*columns)


def _padded(column: str) -> Column:
    """Surround values of even length with blanks."""
    c = F.col(column)
    return F.when(F.length(c) % 2 == 0, F.concat(F.lit("  "), c, F.lit(" \t"))).otherwise(c)


def _bare_zip(column: str) -> Column:
    """ZIP prefix as the source has it: a number without leading zeros."""
    return F.col(column).cast("int").cast("string")


def _as_float(column: str) -> Column:
    return F.col(column).cast("decimal(12,1)").cast("string")


def _two_digits(column: str) -> Column:
    return F.col(column).cast("decimal(12,2)").cast("string")


def _special(table: str) -> dict[str, Column]:
    """Columns whose raw text differs from the cleaned value."""
    if table == "customers":
        return {
            "customer_zip_code_prefix": _bare_zip("customer_zip_code_prefix"),
            "customer_city": _padded("customer_city"),
        }
    if table == "orders":
        return {"order_status": _padded("order_status")}
    if table == "order_items":
        return {name: _two_digits(name) for name in ("price", "freight_value")}
    if table == "payments":
        return {
            "payment_type": _padded("payment_type"),
            "payment_value": _two_digits("payment_value"),
        }
    if table == "reviews":
        return {
            "review_comment_title": _padded("review_comment_title"),
            "review_comment_message": F.coalesce("review_comment_message", F.lit("   ")),
        }
    if table == "products":
        integers = [f.name for f in SCHEMAS[table].fields if f.dataType.typeName() == "integer"]
        return {name: _as_float(name) for name in integers}
    if table == "sellers":
        return {"seller_zip_code_prefix": _bare_zip("seller_zip_code_prefix")}
    if table == "geolocation":
        return {"geolocation_zip_code_prefix": _bare_zip("geolocation_zip_code_prefix")}
    return {}


def bind_raw(spark: SparkSession, folder: str) -> Marketplace:
    """The same tables as untidy text; geolocation keeps its exact duplicates."""
    t = _Tables(spark, folder)
    clean = bind(spark, folder).replaced(
        geolocation=lambda: _geolocation(t, deduplicated=False)
    )

    def raw(table: str):
        return lambda: _raw_text(clean[table], table, _special(table))

    return Marketplace({table: raw(table) for table in SCHEMAS})
