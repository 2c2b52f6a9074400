"""Audit of the tables: structure, keys, duplicates, gaps, domains, numbers, time, text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarscope.functions import domain as D
from bazaarscope.functions import metrics as M
from bazaarscope.operators.keys import (
    childless_rows,
    duplicate_profile,
    key_profile,
    orphan_rows,
)
from bazaarscope.operators.ordered import decimal_key, histogram, quantiles
from bazaarscope.operators.profile import (
    distinct_counts,
    long_aggregate,
    union_all,
    values_long,
)
from bazaarscope.sources.model import SCHEMAS, TABLES, Marketplace

c = F.col


def _tag(df: DataFrame, **labels: str) -> DataFrame:
    return df.select(*[F.lit(v).alias(k) for k, v in labels.items()], "*")


def _instant(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


# -- structure -------------------------------------------------------------------------
def inventory(mk: Marketplace) -> DataFrame:
    return union_all([
        df.agg(F.count("*").alias("rows")).select(
            F.lit(table).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        for table, df in mk.items()
    ])


def structure(mk: Marketplace, exact: bool = True) -> DataFrame:
    """Per column: type, non-null, null and distinct values.

    ``exact=False`` estimates the distinct values in the same single pass.
    """
    parts = []
    for table, df in mk.items():
        if exact:
            counts = distinct_counts(df)
        else:
            counts = long_aggregate(df, [
                (
                    {"column_name": F.lit(name)},
                    {
                        "non_null_count": F.count(name),
                        "null_count": M.rows_where(c(name).isNull()),
                        "unique_values": F.approx_count_distinct(name),
                    },
                )
                for name in df.columns
            ])
        parts.append(_tag(counts, table_name=table))
    return union_all(parts)


def column_types(mk: Marketplace) -> DataFrame:
    """Declared against actual type and position of every column; driver metadata only."""
    rows = []
    for table, df in mk.items():
        actual = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)}
        for i, field in enumerate(SCHEMAS[table].fields):
            position, kind = actual.get(field.name, (None, None))
            declared = field.dataType.simpleString()
            rows.append((table, field.name, declared, kind, position == i, kind == declared))
    schema = (
        "table_name string, column_name string, declared_type string, actual_type string, "
        "position_matches boolean, type_matches boolean"
    )
    return mk.orders.sparkSession.createDataFrame(rows, schema)


# -- keys and relationships --------------------------------------------------------------
def key_checks(mk: Marketplace) -> DataFrame:
    parts = [
        _tag(key_profile(mk[table], keys), table_name=table, key_columns=" + ".join(keys))
        for table, keys in D.PRIMARY_KEYS.items()
    ]
    unique = c("unique_combinations") == c("total_rows")
    complete = c("missing_key_rows") == 0
    return union_all(parts).select(
        "*",
        unique.alias("is_unique"),
        complete.alias("is_complete"),
        (unique & complete).alias("valid_key"),
    )


def duplicates(mk: Marketplace) -> DataFrame:
    parts = [_tag(duplicate_profile(df), table_name=table) for table, df in mk.items()]
    return union_all(parts).withColumn(
        "duplicate_row_pct", M.pct(c("rows_in_duplicate_groups"), c("total_rows"))
    )


def repeated_ids(mk: Marketplace) -> DataFrame:
    """Rows whose identifier occurs more than once, and how many identifiers do."""
    parts = []
    for table, identifier in (("customers", "customer_unique_id"), ("reviews", "review_id")):
        per_id = mk[table].groupBy(identifier).agg(F.count("*").alias("n"))
        parts.append(per_id.agg(
            F.coalesce(F.sum(F.when(c("n") > 1, c("n"))), F.lit(0)).alias("repeated_rows"),
            F.count_if(c("n") > 1).alias("repeated_identifiers"),
        ).select(
            F.lit(table).alias("table_name"), F.lit(identifier).alias("identifier"), "*"
        ))
    return union_all(parts)


def relationship_orphans(mk: Marketplace) -> DataFrame:
    parts = [
        _tag(
            orphan_rows(mk[child], child_key, mk[parent], parent_key),
            relationship=f"{child}.{child_key} -> {parent}",
        )
        for child, child_key, parent, parent_key in D.FOREIGN_KEYS
    ]
    valid = c("orphan_rows") == 0
    return union_all(parts).withColumn(
        "status", F.when(valid, D.NO_ORPHANS).otherwise(D.HAS_ORPHANS)
    )


def parent_coverage(mk: Marketplace) -> DataFrame:
    return union_all([
        _tag(
            childless_rows(mk[parent], parent_key, mk[child], child_key),
            relationship=label,
        )
        for label, parent, parent_key, child, child_key in D.PARENT_COVERAGE
    ])


def cardinality(mk: Marketplace) -> DataFrame:
    """Minimum, median, maximum and average group size of each relationship."""
    sizes = [
        mk[table].filter(c(column).isNotNull()).groupBy(column).agg(F.count("*").alias("size"))
        .select(F.lit(label).alias("relationship"), "size")
        for label, table, column in D.CARDINALITIES
    ]
    sizes.append(
        mk.order_items.groupBy("order_id")
        .agg(F.count_distinct("seller_id").alias("size"))
        .select(F.lit("unique sellers per order").alias("relationship"), "size")
    )
    hist = histogram(union_all(sizes), "size", ["relationship"])
    by = ["relationship"]
    medians = quantiles(hist, "size", c("size"), linear={"median": 50}, by=by)
    spread = hist.groupBy("relationship").agg(
        F.min("size").alias("minimum"),
        F.max("size").alias("maximum"),
        M.avg2(F.sum(c("size") * c("n")), F.sum("n")).alias("average"),
    )
    return spread.join(medians, "relationship").select(
        "relationship", "minimum", "median", "maximum", "average"
    )


# -- missing values ---------------------------------------------------------------------
def missing_values(mk: Marketplace) -> DataFrame:
    """Columns that have NULLs: count and percentage of the table."""
    parts = [
        long_aggregate(df, [
            (
                {"table_name": F.lit(table), "column_name": F.lit(name)},
                {"total_rows": F.count("*"), "missing_count": M.rows_where(c(name).isNull())},
            )
            for name in df.columns
        ])
        for table, df in mk.items()
    ]
    return union_all(parts).filter(c("missing_count") > 0).withColumn(
        "missing_pct", M.pct(c("missing_count"), c("total_rows"))
    )


def missing_by_table(mk: Marketplace) -> DataFrame:
    return missing_values(mk).groupBy("table_name").agg(
        F.count("*").alias("columns_with_missing"),
        F.sum("missing_count").alias("total_missing_values"),
    )


# -- categorical values -----------------------------------------------------------------
def distributions(mk: Marketplace) -> DataFrame:
    """Row count of every value, NULL included, of the categorical columns."""
    parts = [
        mk[table].groupBy(c(column).cast("string").alias("value"))
        .agg(F.count("*").alias("row_count"))
        .select(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
            "value", "row_count",
        )
        for table, column in D.CATEGORICAL_COLUMNS
    ]
    return union_all(parts)


def domain_violations(mk: Marketplace) -> DataFrame:
    """Values outside the allowed status and payment-type domains, with their rows."""
    parts = []
    for table, column, allowed in (
        ("orders", "order_status", D.ORDER_STATUSES),
        ("payments", "payment_type", D.PAYMENT_TYPES),
    ):
        outside = mk[table].filter(c(column).isNotNull() & ~c(column).isin(*allowed))
        parts.append(outside.groupBy(c(column).alias("value")).agg(
            F.count("*").alias("row_count")
        ).select(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
            "value", "row_count",
        ))
    return union_all(parts)


def state_codes(mk: Marketplace, allowed: Sequence[str] = D.STATE_CODES) -> DataFrame:
    """Missing and unknown state codes, ignoring case and surrounding blanks."""
    parts = []
    for table, column in D.STATE_COLUMNS.items():
        code = F.upper(M.stripped(c(column)))
        unknown = code.isNotNull() & ~code.isin(*allowed)
        per_code = mk[table].groupBy(code.alias("code"), unknown.alias("unknown")).agg(
            F.count("*").alias("n")
        )
        parts.append(per_code.agg(
            F.coalesce(F.sum(F.when(c("code").isNull(), c("n"))), F.lit(0)).alias("missing_rows"),
            F.coalesce(F.sum(F.when(c("unknown"), c("n"))), F.lit(0)).alias(
                "invalid_state_code_rows"),
            F.count_if(c("unknown")).alias("invalid_values"),
        ).select(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "*"
        ))
    return union_all(parts)


# -- numbers -------------------------------------------------------------------------------
def _numeric_histogram(mk: Marketplace, columns: dict[str, Sequence[str]]) -> DataFrame:
    """table_name, column_name, value and its number of rows, for numeric columns."""
    cells = [
        _tag(values_long(mk[table], names, "double"), table_name=table)
        for table, names in columns.items()
    ]
    return (
        union_all(cells)
        .groupBy("table_name", "column_name", "value")
        .agg(F.count("*").alias("n"))
    )


_COLUMN = ["table_name", "column_name"]


def _order_key() -> Column:
    return decimal_key(c("value"))


def numeric_profile(mk: Marketplace) -> DataFrame:
    """Count, missing, minimum, quartiles, maximum, zeros and negatives per column."""
    cells = _numeric_histogram(mk, D.NUMERIC_COLUMNS)
    value, n = c("value"), c("n")
    present = cells.filter(value.isNotNull())
    quartiles = quantiles(
        present, "value", _order_key(), linear={"q1": 25, "median": 50, "q3": 75}, by=_COLUMN
    )

    def rows(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    counts = cells.groupBy(*_COLUMN).agg(
        rows(value.isNotNull()).alias("count"),
        rows(value.isNull()).alias("missing_count"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        rows(value == 0).alias("zero_count"),
        rows(value < 0).alias("negative_count"),
    )
    return counts.join(quartiles, _COLUMN, "left").select(
        *_COLUMN, "count", "missing_count", "minimum", "q1", "median", "q3", "maximum",
        "zero_count", "negative_count",
    )


def outliers(mk: Marketplace) -> DataFrame:
    """Rows outside the quartiles by more than 1.5 times their distance; a flag only."""
    present = _numeric_histogram(mk, D.OUTLIER_COLUMNS).filter(c("value").isNotNull())
    spread = c("q3") - c("q1")
    bounds = quantiles(
        present, "value", _order_key(), linear={"q1": 25, "q3": 75}, by=_COLUMN
    ).select(
        *_COLUMN,
        (c("q1") - 1.5 * spread).alias("lower_bound"),
        (c("q3") + 1.5 * spread).alias("upper_bound"),
    )
    outside = (c("value") < c("lower_bound")) | (c("value") > c("upper_bound"))
    # one bound row per column of the list above, so the broadcast side is bounded
    return (
        present.join(F.broadcast(bounds), _COLUMN)
        .groupBy(*_COLUMN, "lower_bound", "upper_bound")
        .agg(F.coalesce(F.sum(F.when(outside, c("n"))), F.lit(0)).alias("flagged_rows"))
    )


def _rules(mk: Marketplace, rules: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    """table_name, check, affected_rows: one aggregate per table."""
    return union_all([
        long_aggregate(mk[table], [
            ({"table_name": F.lit(table), "check": F.lit(label)},
             {"affected_rows": M.rows_where(test)})
            for label, test in checks
        ])
        for table, checks in rules.items()
    ])


def _conditions(*texts: str) -> list[tuple[str, Column]]:
    """Each condition labelled with its own text."""
    return [(text, F.expr(text)) for text in texts]


def _broken(*texts: str) -> list[tuple[str, Column]]:
    """Rows that break a requirement; an unknown value breaks it too."""
    return [(text, ~F.coalesce(F.expr(text), F.lit(False))) for text in texts]


def audit_rules() -> dict[str, list[tuple[str, Column]]]:
    """Values that need a look before loading."""
    return {
        "order_items": _conditions("price <= 0", "freight_value < 0"),
        "payments": _conditions("payment_value <= 0", "payment_installments <= 0"),
        "products": _conditions(*(f"{name} <= 0" for name in D.OUTLIER_COLUMNS["products"])),
        "reviews": _conditions("review_score NOT BETWEEN 1 AND 5"),
    }


def domain_rules() -> dict[str, list[tuple[str, Column]]]:
    """Values that break the constraints of the loaded tables."""
    products = D.NUMERIC_COLUMNS["products"]
    groups = (products[:3], products[3:])
    return {
        "order_items": _conditions("order_item_id < 1", "price <= 0", "freight_value < 0"),
        "payments": _conditions(
            "payment_sequential < 1", "payment_installments < 0", "payment_value < 0"
        ),
        "products": _conditions(*(f"least({', '.join(names)}) < 0" for names in groups)),
        "geolocation": _broken(
            "geolocation_lat BETWEEN -90 AND 90", "geolocation_lng BETWEEN -180 AND 180"
        ),
        "reviews": _broken("review_score BETWEEN 1 AND 5"),
    }


def numeric_rule_checks(mk: Marketplace) -> DataFrame:
    return _rules(mk, audit_rules())


def domain_rule_checks(mk: Marketplace) -> DataFrame:
    return _rules(mk, domain_rules())


# -- time ------------------------------------------------------------------------------------
def date_ranges(mk: Marketplace) -> DataFrame:
    parts = []
    for table in TABLES:
        names = [f.name for f in SCHEMAS[table].fields
                 if isinstance(f.dataType, T.TimestampNTZType)]
        if names:
            parts.append(long_aggregate(mk[table], [
                (
                    {"table_name": F.lit(table), "column_name": F.lit(name)},
                    {
                        "minimum_date": F.min(name),
                        "maximum_date": F.max(name),
                        "missing_rows": M.rows_where(c(name).isNull()),
                    },
                )
                for name in names
            ]))
    return union_all(parts)


def order_timeline_rules() -> list[tuple[str, Column]]:
    purchase, customer = "order_purchase_timestamp", "order_delivered_customer_date"
    carrier = "order_delivered_carrier_date"
    pairs = [
        ("order_approved_at", purchase), (carrier, purchase), (customer, purchase),
        (customer, carrier), ("order_estimated_delivery_date", purchase),
    ]
    return _conditions(*(f"{later} < {earlier}" for later, earlier in pairs))


def order_timeline(mk: Marketplace) -> DataFrame:
    return _rules(mk, {"orders": order_timeline_rules()})


def shipping_rules(late_from: str) -> list[tuple[str, Column]]:
    limit = c("shipping_limit_date")
    return [
        ("shipping_limit_date < order_purchase_timestamp", limit < c("order_purchase_timestamp")),
        ("shipping_limit_date beyond the period", limit >= _instant(late_from)),
    ]


def shipping_limits(mk: Marketplace, late_from: str) -> DataFrame:
    """Shipping limits before the purchase and on or after a given day."""
    # limits of one order are compared through their distinct values
    per_limit = mk.order_items.groupBy("order_id", "shipping_limit_date").agg(
        F.count("*").alias("n")
    )
    rows = per_limit.join(
        mk.orders.select("order_id", "order_purchase_timestamp"), "order_id", "left"
    )
    return long_aggregate(rows, [
        ({"table_name": F.lit("order_items"), "check": F.lit(label)},
         {"affected_rows": F.coalesce(F.sum(F.when(test, c("n"))), F.lit(0))})
        for label, test in shipping_rules(late_from)
    ])


def review_rules() -> list[tuple[str, Column]]:
    """Survey before purchase, answer before survey, survey before it could be due.

    Calendar days are compared; a survey may go out at delivery or at the estimate.
    """
    sent = F.to_date("review_creation_date")
    due = F.to_date(
        F.least("order_delivered_customer_date", "order_estimated_delivery_date")
    )
    return [
        ("review_creation_date < purchase day", sent < F.to_date("order_purchase_timestamp")),
        (
            "review_answer_timestamp < review_creation_date",
            c("review_answer_timestamp") < c("review_creation_date"),
        ),
        ("review_creation_date < day it was due", sent < due),
    ]


def review_timeline(mk: Marketplace) -> DataFrame:
    """Rows that break ``review_rules``."""
    rows = mk.reviews.select(
        "order_id", "review_creation_date", "review_answer_timestamp"
    ).join(
        mk.orders.select(
            "order_id", "order_purchase_timestamp", "order_delivered_customer_date",
            "order_estimated_delivery_date",
        ),
        "order_id",
        "left",
    )
    return long_aggregate(rows, [
        ({"table_name": F.lit("reviews"), "check": F.lit(label)},
         {"affected_rows": M.rows_where(test)})
        for label, test in review_rules()
    ])


# -- text ------------------------------------------------------------------------------------
def text_fields(raw: Marketplace) -> DataFrame:
    """Empty, blank and padded values and the range of lengths of every text column."""
    parts = []
    for table, df in raw.items():
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        parts.append(long_aggregate(df, [
            (
                {"table_name": F.lit(table), "column_name": F.lit(name)},
                {
                    "missing_count": M.rows_where(c(name).isNull()),
                    "empty_string_count": M.rows_where(c(name) == ""),
                    "whitespace_only_count": M.rows_where(M.is_blank(c(name))),
                    "padded_count": M.rows_where(M.is_padded(c(name))),
                    "minimum_length": F.min(F.length(name)),
                    "maximum_length": F.max(F.length(name)),
                },
            )
            for name in names
        ]))
    return union_all(parts)


def numeric_city_names(mk: Marketplace) -> DataFrame:
    return union_all([
        long_aggregate(mk[table], [(
            {"table_name": F.lit(table), "column_name": F.lit(column)},
            {"numeric_only_rows": M.rows_where(c(column).rlike("^[0-9]+$"))},
        )])
        for table, column in D.CITY_COLUMNS.items()
    ])


# -- lookups ---------------------------------------------------------------------------------
def _used_categories(mk: Marketplace) -> DataFrame:
    """Categories of the products with their number of products."""
    return (
        mk.products.filter(c("product_category_name").isNotNull())
        .groupBy("product_category_name")
        .agg(F.count("*").alias("products"))
    )


def untranslated_categories(mk: Marketplace) -> DataFrame:
    lookup = mk.category_translation.select("product_category_name")
    return _used_categories(mk).join(lookup, "product_category_name", "left_anti")


def lookup_coverage(mk: Marketplace) -> DataFrame:
    """Lookup gaps in both directions."""
    gaps = untranslated_categories(mk).agg(
        F.count("*").alias("categories"),
        F.coalesce(F.sum("products"), F.lit(0)).alias("products"),
    )
    unused = (
        mk.category_translation.select("product_category_name")
        .join(_used_categories(mk), "product_category_name", "left_anti")
        .agg(F.count("*").alias("n"))
    )
    gap_rows = gaps.select(F.inline(F.array(
        F.struct(F.lit("Distinct product categories without translation").alias("check"),
                 c("categories").alias("affected_count")),
        F.struct(F.lit("product_category_name not in the lookup").alias("check"),
                 c("products").alias("affected_count")),
    )))
    return gap_rows.unionByName(unused.select(
        F.lit("Translations not used by products").alias("check"),
        c("n").alias("affected_count"),
    ))


def zip_coverage(mk: Marketplace) -> DataFrame:
    """Customer and seller ZIP prefixes without a geolocation row."""
    known = mk.geolocation.select(c("geolocation_zip_code_prefix").alias("zip")).distinct()
    parts = []
    for table, column in (
        ("customers", "customer_zip_code_prefix"), ("sellers", "seller_zip_code_prefix"),
    ):
        used = mk[table].groupBy(c(column).alias("zip")).agg(F.count("*").alias("n"))
        parts.append(used.join(known, "zip", "left_anti").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("unmatched_rows"),
            F.count("zip").alias("unmatched_distinct_prefixes"),
        ).select(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "*"
        ))
    return union_all(parts)


def geolocation_density(mk: Marketplace) -> DataFrame:
    """Rows, distinct ZIP prefixes, densest prefix and remaining exact duplicates."""
    per_zip = mk.geolocation.groupBy("geolocation_zip_code_prefix").agg(F.count("*").alias("n"))
    row = per_zip.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("geolocation_rows"),
        F.count("geolocation_zip_code_prefix").alias("distinct_zip_prefixes"),
        F.max("n").alias("maximum_rows_per_zip_prefix"),
    )
    excess = duplicate_profile(mk.geolocation).select("excess_duplicate_rows").scalar()
    return row.withColumn("exact_duplicate_rows", excess)
