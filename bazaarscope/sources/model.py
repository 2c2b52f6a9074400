"""The nine tables of the marketplace: declared schemas and a holder for them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _DBL, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampNTZType(),
)
MONEY = T.DecimalType(10, 2)


def _struct(*cols) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols])


# The cleaned layer. Timestamps carry no zone, like the DATETIME columns they stand for.
SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        ("customer_id", _S),
        ("customer_unique_id", _S),
        ("customer_zip_code_prefix", _S),
        ("customer_city", _S),
        ("customer_state", _S),
    ),
    "orders": _struct(
        ("order_id", _S),
        ("customer_id", _S),
        ("order_status", _S),
        ("order_purchase_timestamp", _TS),
        ("order_approved_at", _TS),
        ("order_delivered_carrier_date", _TS),
        ("order_delivered_customer_date", _TS),
        ("order_estimated_delivery_date", _TS),
    ),
    "order_items": _struct(
        ("order_id", _S),
        ("order_item_id", _I),
        ("product_id", _S),
        ("seller_id", _S),
        ("shipping_limit_date", _TS),
        ("price", MONEY),
        ("freight_value", MONEY),
    ),
    "payments": _struct(
        ("order_id", _S),
        ("payment_sequential", _I),
        ("payment_type", _S),
        ("payment_installments", _I),
        ("payment_value", MONEY),
    ),
    "reviews": _struct(
        ("review_id", _S),
        ("order_id", _S),
        ("review_score", _I),
        ("review_comment_title", _S),
        ("review_comment_message", _S),
        ("review_creation_date", _TS),
        ("review_answer_timestamp", _TS),
    ),
    "products": _struct(
        ("product_id", _S),
        ("product_category_name", _S),
        ("product_name_length", _I),
        ("product_description_length", _I),
        ("product_photos_qty", _I),
        ("product_weight_g", _I),
        ("product_length_cm", _I),
        ("product_height_cm", _I),
        ("product_width_cm", _I),
    ),
    "sellers": _struct(
        ("seller_id", _S),
        ("seller_zip_code_prefix", _S),
        ("seller_city", _S),
        ("seller_state", _S),
    ),
    "geolocation": _struct(
        ("geolocation_zip_code_prefix", _S),
        ("geolocation_lat", _DBL),
        ("geolocation_lng", _DBL),
        ("geolocation_city", _S),
        ("geolocation_state", _S),
    ),
    "category_translation": _struct(
        ("product_category_name", _S),
        ("product_category_name_english", _S),
    ),
}

TABLES = tuple(SCHEMAS)


class Marketplace:
    """The nine tables as lazy DataFrames, reached by name.

    A table may be given as a function; it is then built on first use, so a report plans
    only the tables it reads.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        missing = sorted(set(TABLES) - set(tables))
        unexpected = sorted(set(tables) - set(TABLES))
        if missing or unexpected:
            raise KeyError(f"missing tables: {missing}; unexpected tables: {unexpected}")
        self._tables = dict(tables)

    def __getitem__(self, table: str) -> DataFrame:
        found = self._tables[table]
        if callable(found):
            found = self._tables[table] = found()
        return found

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_") or table not in TABLES:
            raise AttributeError(table)
        return self[table]

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(table, self[table]) for table in TABLES]

    def replaced(self, **tables: DataFrame) -> Marketplace:
        return Marketplace({**self._tables, **tables})

    def collated(self, collation: str = "UNICODE_CI_AI") -> Marketplace:
        """The same tables with text compared by a collation instead of byte by byte.

        The default ignores case and accents, as a relational store may.
        """

        def build(table: str):
            def collate() -> DataFrame:
                df = self[table]
                return df.select(*[
                    F.collate(f.name, collation).alias(f.name)
                    if isinstance(f.dataType, T.StringType)
                    else f.name
                    for f in df.schema.fields
                ])

            return collate

        return Marketplace({table: build(table) for table in TABLES})
