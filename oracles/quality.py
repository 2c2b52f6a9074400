"""Expected results of cleaning, audit, validation and load checks, written for DuckDB."""

from __future__ import annotations

from oracles.roles import avg2, big, money, pct, with_roles

# (role, (role column, model column) ...) of each table
COLUMNS = {
    "customers": ("m_customers", [
        ("customer_id", "customer_id"), ("person", "customer_unique_id"),
        ("zip", "customer_zip_code_prefix"), ("city", "customer_city"),
        ("state", "customer_state"),
    ]),
    "orders": ("m_orders", [
        ("order_id", "order_id"), ("customer_id", "customer_id"),
        ("order_status", "order_status"), ("bought", "order_purchase_timestamp"),
        ("approved", "order_approved_at"), ("carried", "order_delivered_carrier_date"),
        ("arrived", "order_delivered_customer_date"), ("due", "order_estimated_delivery_date"),
    ]),
    "order_items": ("m_items", [
        ("order_id", "order_id"), ("order_item_id", "order_item_id"),
        ("product_id", "product_id"), ("seller_id", "seller_id"),
        ("ship_by", "shipping_limit_date"), ("price", "price"), ("freight_raw", "freight_value"),
    ]),
    "payments": ("m_payments", [
        ("order_id", "order_id"), ("seq", "payment_sequential"), ("method", "payment_type"),
        ("installments", "payment_installments"), ("paid", "payment_value"),
    ]),
    "reviews": ("m_reviews", [
        ("review_id", "review_id"), ("order_id", "order_id"), ("score", "review_score"),
        ("title", "review_comment_title"), ("message", "review_comment_message"),
        ("sent", "review_creation_date"), ("answered", "review_answer_timestamp"),
    ]),
    "products": ("m_products", [
        ("product_id", "product_id"), ("source", "product_category_name"),
        ("name_length", "product_name_length"),
        ("description_length", "product_description_length"), ("photos", "product_photos_qty"),
        ("weight", "product_weight_g"), ("len", "product_length_cm"),
        ("height", "product_height_cm"), ("width", "product_width_cm"),
    ]),
    "sellers": ("m_sellers", [
        ("seller_id", "seller_id"), ("zip", "seller_zip_code_prefix"), ("city", "seller_city"),
        ("state", "seller_state"),
    ]),
    "geolocation": ("m_geo", [
        ("zip", "geolocation_zip_code_prefix"), ("lat", "geolocation_lat"),
        ("lng", "geolocation_lng"), ("city", "geolocation_city"), ("state", "geolocation_state"),
    ]),
    "category_translation": ("m_lookup", [
        ("source", "product_category_name"), ("english", "product_category_name_english"),
    ]),
}
TIMES = {"bought", "approved", "carried", "arrived", "due", "ship_by", "sent", "answered"}
IDS = {"customer_id", "customer_unique_id", "order_id", "product_id", "seller_id", "review_id"}

# full-named tables, geolocation as observed in the raw layer
EXTRA = {
    f"m_t_{table}": "SELECT " + ", ".join(f"{a} AS {b}" for a, b in columns) + f" FROM {role}"
    for table, (role, columns) in COLUMNS.items()
}

KEYS = {
    "customers": ["customer_id"], "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"], "products": ["product_id"],
    "sellers": ["seller_id"], "payments": ["order_id", "payment_sequential"],
    "reviews": ["review_id", "order_id"], "category_translation": ["product_category_name"],
}
LINKS = [
    ("orders", "customer_id", "customers"), ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"), ("order_items", "seller_id", "sellers"),
    ("payments", "order_id", "orders"), ("reviews", "order_id", "orders"),
]
GAPS = [
    ("customers_without_orders", "customers", "customer_id", "orders"),
    ("orders_without_items", "orders", "order_id", "order_items"),
    ("orders_without_payments", "orders", "order_id", "payments"),
    ("orders_without_reviews", "orders", "order_id", "reviews"),
    ("products_without_sales", "products", "product_id", "order_items"),
    ("sellers_without_sales", "sellers", "seller_id", "order_items"),
]
NUMBERS = {
    "order_items": ["order_item_id", "price", "freight_value"],
    "products": ["product_name_length", "product_description_length", "product_photos_qty",
                 "product_weight_g", "product_length_cm", "product_height_cm",
                 "product_width_cm"],
    "payments": ["payment_sequential", "payment_installments", "payment_value"],
    "reviews": ["review_score"], "geolocation": ["geolocation_lat", "geolocation_lng"],
}
WATCHED = {
    "order_items": ["price", "freight_value"], "payments": ["payment_value"],
    "products": ["product_weight_g", "product_length_cm", "product_height_cm",
                 "product_width_cm"],
}
OPTIONAL = {
    "orders": ["order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"],
    "reviews": ["review_comment_title", "review_comment_message"],
    "products": ["product_category_name", *NUMBERS["products"]],
}
STATES = "'AC','AL','AP','AM','BA','CE','DF','ES','GO','MA','MT','MS','MG','PA','PB','PR','PE'," \
         "'PI','RJ','RN','RS','RO','RR','SC','SP','SE','TO'"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def sql(body: str) -> str:
    return with_roles(body, EXTRA)


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


# -- cleaning ----------------------------------------------------------------------------
def cleaned(table: str) -> str:
    role, columns = COLUMNS[table]
    out = []
    for source, name in columns:
        if source in TIMES:
            out.append(f"{iso(source)} AS {name}")
        elif name in IDS:
            out.append(f"CAST({source} AS VARCHAR) AS {name}")
        elif name in ("price", "freight_value", "payment_value"):
            out.append(f"{money(source)} AS {name}")
        elif name.startswith("product_") and name not in ("product_category_name",
                                                            "product_category_name_english"):
            out.append(f"CAST({source} AS INTEGER) AS {name}")
        else:
            out.append(f"{source} AS {name}")
    return f"SELECT {', '.join(out)} FROM {role}"


# raw text of a column as the raw layer writes it, where it differs from the value
PADDED = "CASE WHEN length({x}) % 2 = 0 THEN '  ' || {x} || ' ' || chr(9) ELSE {x} END"
RAW_TEXT = {
    "customer_city": PADDED.format(x="city"), "order_status": PADDED.format(x="order_status"),
    "payment_type": PADDED.format(x="method"), "review_comment_title": PADDED.format(x="title"),
    "review_comment_message": "coalesce(message, '   ')",
}
TEXT = {
    "customers": ["customer_city", "customer_state"], "sellers": ["seller_city", "seller_state"],
    "geolocation": ["geolocation_city", "geolocation_state"], "orders": ["order_status"],
    "payments": ["payment_type"], "products": ["product_category_name"],
    "reviews": ["review_comment_title", "review_comment_message"],
    "category_translation": ["product_category_name", "product_category_name_english"],
}
ZIPS = {"customers": "customer_zip_code_prefix", "sellers": "seller_zip_code_prefix",
        "geolocation": "geolocation_zip_code_prefix"}


def raw_role(table: str) -> str:
    return "m_geo_observed" if table == "geolocation" else COLUMNS[table][0]


def raw_value(table: str, name: str) -> str:
    """Text of a column in the raw layer."""
    source = {b: a for a, b in COLUMNS[table][1]}[name]
    if name in RAW_TEXT:
        return f"({RAW_TEXT[name]})"
    if name == ZIPS.get(table):
        return f"CAST(CAST({source} AS INTEGER) AS VARCHAR)"
    if table == "products" and name in NUMBERS["products"]:
        return f"({source} || '.0')"
    if source in TIMES:
        return iso(source)
    if name in ("price", "freight_value"):
        return f"CAST(CAST({source} AS DECIMAL(12,2)) AS VARCHAR)"
    return f"CAST({source} AS VARCHAR)"


def change_summary() -> str:
    parts = []
    for table, (_, columns) in COLUMNS.items():
        for source, name in columns:
            raw, changed, blank, after = raw_value(table, name), "false", "false", source
            if source in TIMES:
                step = "timestamp"
            elif name == ZIPS.get(table):
                step, changed = "zip_prefix", f"{raw} <> {source}"
            elif table == "products" and name in NUMBERS["products"]:
                step, changed = "whole_number", f"{source} IS NOT NULL"
            elif name in TEXT.get(table, []):
                step = "text"
                trimmed = f"regexp_replace({raw}, '^\\s+|\\s+$', '', 'g')"
                changed, blank = f"{raw} <> {trimmed}", f"{trimmed} = ''"
            else:
                continue
            parts.append(
                f"SELECT '{table}' AS table_name, '{name}' AS column_name, '{step}' AS step, "
                f"count(*) FILTER ({raw} IS NULL) AS missing_before, "
                f"count(*) FILTER ({after} IS NULL) AS missing_after, "
                f"count(*) FILTER ({changed}) AS values_changed, "
                f"count(*) FILTER ({blank}) AS blank_to_missing FROM {raw_role(table)}")
    return sql(union(parts))


def violations() -> str:
    parts = []
    for table, (_, columns) in COLUMNS.items():
        for source, name in columns:
            typed = (source in TIMES or name == ZIPS.get(table)
                     or name in NUMBERS.get(table, []))
            if typed:
                parts.append(
                    f"SELECT '{table}' AS table_name, '{name}' AS column_name, "
                    f"count({source}) AS source_non_null, count({source}) AS converted, "
                    f"count(*) - count(*) AS failures FROM {raw_role(table)}")
    return sql(union(parts))


def row_changes() -> str:
    return sql(union(
        f"SELECT '{table}' AS table_name, (SELECT count(*) FROM {raw_role(table)}) AS raw_rows, "
        f"count(*) AS cleaned_rows, "
        f"count(*) - (SELECT count(*) FROM {raw_role(table)}) AS row_difference, "
        f"{len(columns)} AS raw_columns, {len(columns)} AS cleaned_columns FROM {role}"
        for table, (role, columns) in COLUMNS.items()))


DUPLICATE_REMOVAL = sql("""
SELECT count(*) AS rows_before, count(*) - (SELECT count(*) FROM m_geo) AS exact_duplicates_detected,
  count(*) - (SELECT count(*) FROM m_geo) AS rows_removed,
  (SELECT count(*) FROM m_geo) AS rows_after, count(*) - count(*) AS exact_duplicates_remaining
FROM m_geo_observed""")

_EARLY_SURVEY = """(SELECT count(*) FROM m_reviews JOIN m_orders USING (order_id)
   WHERE CAST(sent AS DATE) < CAST(bought AS DATE))"""
_REPEATED_REVIEW = """(SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM m_reviews
   GROUP BY review_id HAVING count(*) > 1))"""
_UNTRANSLATED = """(SELECT count(*) FROM m_products WHERE source IS NOT NULL
   AND source NOT IN (SELECT source FROM m_lookup))"""


def retained() -> str:
    keep, flag = "Retain", "Retain and flag during analysis"
    rows = [
        ("orders", "order_approved_at IS NULL", "m_orders", "approved IS NULL", keep),
        ("orders", "order_delivered_carrier_date IS NULL", "m_orders", "carried IS NULL", keep),
        ("orders", "order_delivered_customer_date IS NULL", "m_orders", "arrived IS NULL", keep),
        ("orders", "order_delivered_carrier_date < order_purchase_timestamp", "m_orders", "carried < bought", flag),
        ("orders", "order_delivered_customer_date < order_delivered_carrier_date", "m_orders", "arrived < carried",
         flag),
        ("reviews", "review_comment_title IS NULL", "m_reviews", "title IS NULL", keep),
        ("reviews", "review_comment_message IS NULL", "m_reviews", "message IS NULL", keep),
        ("products", "product_category_name IS NULL", "m_products", "source IS NULL", keep),
        ("products", "some size IS NULL", "m_products",
         "weight + len + height + width IS NULL", keep),
        ("products", "product_weight_g <= 0", "m_products", "weight <= 0", keep),
        ("payments", "payment_type = not_defined", "m_payments", "method = 'not_defined'", keep),
        ("payments", "payment_value <= 0", "m_payments", "paid <= 0", keep),
        ("payments", "payment_installments <= 0", "m_payments", "installments <= 0", keep),
        ("order_items", "shipping_limit_date beyond the period", "m_items",
         "ship_by >= '2001-01-01'", flag),
    ]
    parts = [
        f"SELECT '{t}' AS table_name, '{label}' AS condition, count(*) AS affected_rows, "
        f"'{decision}' AS decision FROM {role} WHERE {test}"
        for t, label, role, test, decision in rows
    ]
    parts += [
        f"SELECT 'reviews', 'review_id repeated', {big(_REPEATED_REVIEW)}, '{keep}'",
        f"SELECT 'products', 'product_category_name not in the lookup', {_UNTRANSLATED}, "
        f"'Retain source category'",
        f"SELECT 'reviews', 'review_creation_date < purchase day', {_EARLY_SURVEY}, "
        f"'{flag}'",
    ]
    return sql(union(parts))


def _key_loss(table: str) -> str:
    keys = KEYS[table]
    return f"(SELECT count(*) - count(DISTINCT ({', '.join(keys)})) FROM m_t_{table})"


def assertions() -> str:
    parts = []
    for table in COLUMNS:
        role_columns = {b: a for a, b in COLUMNS[table][1]}
        if table in ZIPS:
            parts.append(f"SELECT '{table}' AS table_name, '{ZIPS[table]} has five digits' AS c, "
                         f"count(*) FILTER (length({role_columns[ZIPS[table]]}) <> 5) AS v "
                         f"FROM {COLUMNS[table][0]}")
        for name in TEXT.get(table, []):
            parts.append(f"SELECT '{table}' AS table_name, '{name} is trimmed and not blank' AS c,"
                         f" count(*) FILTER (trim({role_columns[name]}) <> {role_columns[name]}) "
                         f"AS v FROM {COLUMNS[table][0]}")
        parts.append(f"SELECT '{table}', 'declared names and types', 0")
    for table, keys in KEYS.items():
        parts.append(f"SELECT '{table}', 'key is complete and unique: {' + '.join(keys)}', "
                     f"{_key_loss(table)}")
    parts += ["SELECT 'geolocation', 'no exact duplicates', 0",
              "SELECT 'products', 'raw names kept', 0"]
    return sql(f"SELECT table_name, c AS \"check\", {big('v')} AS violations, v = 0 AS passed "
               f"FROM ({union(parts)})")


# -- audit ---------------------------------------------------------------------------------
INVENTORY = sql(union(
    f"SELECT '{t}' AS table_name, count(*) AS rows, {len(cols)} AS columns FROM {role}"
    for t, (role, cols) in COLUMNS.items()))

STRUCTURE = sql(union(
    f"SELECT '{t}' AS table_name, '{b}' AS column_name, count({a}) AS non_null_count, "
    f"count(*) - count({a}) AS null_count, count(DISTINCT {a}) AS unique_values FROM {role}"
    for t, (role, cols) in COLUMNS.items() for a, b in cols))


def _profile(table: str, keys) -> str:
    tuple_ = f"({', '.join(keys)})"
    null = " OR ".join(f"{k} IS NULL" for k in keys)
    return (f"SELECT '{table}' AS table_name, '{' + '.join(keys)}' AS key_columns, "
            f"count(*) AS total_rows, count(DISTINCT {tuple_}) AS unique_combinations, "
            f"count(*) FILTER ({null}) AS missing_key_rows FROM m_t_{table}")


_KEY_ROWS = union(_profile(t, k) for t, k in KEYS.items())
KEY_CHECKS = sql(f"""
SELECT *, unique_combinations = total_rows AS is_unique, missing_key_rows = 0 AS is_complete,
  unique_combinations = total_rows AND missing_key_rows = 0 AS valid_key FROM ({_KEY_ROWS})""")


def _dup(table: str, role: str) -> str:
    return (f"SELECT '{table}' AS table_name, {big('sum(k)')} AS total_rows, "
            f"{big('coalesce(sum(k) FILTER (k > 1), 0)')} AS rows_in_duplicate_groups, "
            f"count(*) FILTER (k > 1) AS duplicate_groups, "
            f"{big('sum(k - 1)')} AS excess_duplicate_rows "
            f"FROM (SELECT count(*) AS k FROM (SELECT * FROM {role}) x GROUP BY x)")


_DUP_ROWS = union(_dup(t, role) for t, (role, _) in COLUMNS.items())
_DUP_RAW = union(_dup(t, raw_role(t)) for t in COLUMNS)
_DUP_PCT = pct("rows_in_duplicate_groups", "total_rows")
DUPLICATES = sql(f"SELECT *, {_DUP_PCT} AS duplicate_row_pct FROM ({_DUP_ROWS})")
DUPLICATES_RAW = sql(f"SELECT *, {_DUP_PCT} AS duplicate_row_pct FROM ({_DUP_RAW})")


def _repeats(table: str, role: str, column: str, name: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{name}' AS identifier, "
            f"{big('coalesce(sum(k) FILTER (k > 1), 0)')} AS repeated_rows, "
            f"count(*) FILTER (k > 1) AS repeated_identifiers "
            f"FROM (SELECT count(*) AS k FROM {role} GROUP BY {column})")


_REPEATS = union([_repeats("customers", "m_customers", "person", "customer_unique_id"),
                  _repeats("reviews", "m_reviews", "review_id", "review_id")])
REPEATED_IDS = sql(_REPEATS)

_ORPHANS = union(
    f"SELECT '{child}.{key} -> {parent}' AS relationship, count(*) AS orphan_rows "
    f"FROM m_t_{child} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM m_t_{parent})"
    for child, key, parent in LINKS)
ORPHANS = sql(f"SELECT *, if(orphan_rows = 0, 'Valid', 'Requires investigation') AS status "
              f"FROM ({_ORPHANS})")

_COVERAGE = union(
    f"SELECT '{label}' AS relationship, count(*) AS childless_rows FROM m_t_{parent} "
    f"WHERE {key} NOT IN (SELECT {key} FROM m_t_{child})" for label, parent, key, child in GAPS)
COVERAGE = sql(_COVERAGE)

_SIZES = union(
    f"SELECT '{label}' AS relationship, {count} AS k FROM {role} GROUP BY {column}"
    for label, role, column, count in [
        ("orders per customer record", "m_orders", "customer_id", "count(*)"),
        ("customer records per unique customer", "m_customers", "person", "count(*)"),
        ("items per order", "m_items", "order_id", "count(*)"),
        ("payments per order", "m_payments", "order_id", "count(*)"),
        ("reviews per order", "m_reviews", "order_id", "count(*)"),
        ("unique sellers per order", "m_items", "order_id", "count(DISTINCT seller_id)"),
    ])
CARDINALITY = sql(f"""
SELECT relationship, min(k) AS minimum, CAST(median(k) AS DOUBLE) AS median, max(k) AS maximum,
  {avg2("sum(k)", "count(*)")} AS average FROM ({_SIZES}) GROUP BY relationship""")


def _missing(raw: bool) -> str:
    rows = union(
        f"SELECT '{t}' AS table_name, '{b}' AS column_name, count(*) AS total_rows, "
        f"count(*) FILTER ({raw_value(t, b) if raw else a} IS NULL) AS missing_count "
        f"FROM {raw_role(t) if raw else role}"
        for t, (role, cols) in COLUMNS.items() for a, b in cols)
    return (f"SELECT *, {pct('missing_count', 'total_rows')} AS missing_pct FROM ({rows}) "
            f"WHERE missing_count > 0")


MISSING = sql(_missing(raw=False))
MISSING_BY_TABLE = sql(f"""
SELECT table_name, count(*) AS columns_with_missing,
  {big("sum(missing_count)")} AS total_missing_values
FROM ({_missing(raw=False)}) GROUP BY table_name""")

DISTRIBUTIONS = sql(union(
    f"SELECT '{t}' AS table_name, '{name}' AS column_name, CAST({name} AS VARCHAR) AS value, "
    f"count(*) AS row_count FROM m_t_{t} GROUP BY {name}"
    for t, name in [("orders", "order_status"), ("payments", "payment_type"),
                    ("reviews", "review_score"), ("customers", "customer_state"),
                    ("sellers", "seller_state"), ("geolocation", "geolocation_state")]))

_STATUS_LIST = "'approved','canceled','created','delivered','invoiced','processing','shipped'," \
               "'unavailable'"
# the raw statuses and methods are padded for some values; whatever is not allowed is listed
DOMAIN_VIOLATIONS = sql(f"""
SELECT 'orders' AS table_name, 'order_status' AS column_name, v AS value, count(*) AS row_count
FROM (SELECT {RAW_TEXT["order_status"]} AS v FROM m_orders) WHERE v NOT IN ({_STATUS_LIST})
GROUP BY v
UNION ALL
SELECT 'payments', 'payment_type', v, count(*)
FROM (SELECT {RAW_TEXT["payment_type"]} AS v FROM m_payments)
WHERE v NOT IN ('boleto', 'credit_card', 'debit_card', 'not_defined', 'voucher') GROUP BY v""")

_STATE_ROWS = union(
    f"SELECT '{t}' AS table_name, '{p}_state' AS column_name, "
    f"count(*) FILTER (state IS NULL) AS missing_rows, "
    f"count(*) FILTER (upper(state) NOT IN ({STATES})) AS invalid_state_code_rows, "
    f"count(DISTINCT state) FILTER (upper(state) NOT IN ({STATES})) AS invalid_values FROM {role}"
    for t, p, role in [("customers", "customer", "m_customers"), ("sellers", "seller", "m_sellers"),
                       ("geolocation", "geolocation", "m_geo")])
STATE_CODES = sql(_STATE_ROWS)

_CELLS = union(
    f"SELECT '{t}' AS table_name, '{x}' AS column_name, CAST({x} AS DOUBLE) AS v FROM m_t_{t}"
    for t, names in NUMBERS.items() for x in names)
NUMERIC_PROFILE = sql(f"""
SELECT table_name, column_name, count(v) AS count, count(*) - count(v) AS missing_count,
  min(v) AS minimum, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.75) AS q3, max(v) AS maximum, count(*) FILTER (v = 0) AS zero_count,
  count(*) FILTER (v < 0) AS negative_count FROM ({_CELLS}) GROUP BY ALL""")

_WATCHED = union(
    f"SELECT '{t}' AS table_name, '{x}' AS column_name, CAST({x} AS DOUBLE) AS v FROM m_t_{t}"
    for t, names in WATCHED.items() for x in names)
_OUTLIERS = f"""
SELECT table_name, column_name, lo AS lower_bound, hi AS upper_bound,
  count(*) FILTER (v < lo OR v > hi) AS flagged_rows
FROM ({_WATCHED}) JOIN (
  SELECT table_name, column_name, q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi
  FROM (SELECT table_name, column_name, quantile_cont(v, [0.25, 0.75]) AS q
        FROM ({_WATCHED}) GROUP BY ALL)) USING (table_name, column_name) GROUP BY ALL"""
OUTLIERS = sql(_OUTLIERS)


def _rules(rows) -> str:
    return union(
        f"SELECT '{t}' AS table_name, '{label}' AS \"check\", "
        f"count(*) FILTER ({test}) AS affected_rows FROM m_t_{t}" for t, label, test in rows)


_AUDIT_RULES = _rules([
    ("order_items", "price <= 0", "price <= 0"),
    ("order_items", "freight_value < 0", "freight_value < 0"),
    ("payments", "payment_value <= 0", "payment_value <= 0"),
    ("payments", "payment_installments <= 0", "payment_installments <= 0"),
    ("products", "product_weight_g <= 0", "product_weight_g <= 0"),
    ("products", "product_length_cm <= 0", "product_length_cm <= 0"),
    ("products", "product_height_cm <= 0", "product_height_cm <= 0"),
    ("products", "product_width_cm <= 0", "product_width_cm <= 0"),
    ("reviews", "review_score NOT BETWEEN 1 AND 5", "review_score NOT BETWEEN 1 AND 5"),
])
NUMERIC_RULES = sql(_AUDIT_RULES)

_DOMAIN_RULES = _rules([
    ("order_items", "order_item_id < 1", "order_item_id < 1"),
    ("order_items", "price <= 0", "price <= 0"),
    ("order_items", "freight_value < 0", "freight_value < 0"),
    ("payments", "payment_sequential < 1", "payment_sequential < 1"),
    ("payments", "payment_installments < 0", "payment_installments < 0"),
    ("payments", "payment_value < 0", "payment_value < 0"),
    ("products", "least(product_name_length, product_description_length, product_photos_qty) < 0",
     "least(product_name_length, product_description_length, product_photos_qty) < 0"),
    ("products", "least(product_weight_g, product_length_cm, product_height_cm, product_width_cm) < 0",
     "least(product_weight_g, product_length_cm, product_height_cm, product_width_cm) < 0"),
    ("geolocation", "geolocation_lat BETWEEN -90 AND 90",
     "geolocation_lat IS NULL OR abs(geolocation_lat) > 90"),
    ("geolocation", "geolocation_lng BETWEEN -180 AND 180",
     "geolocation_lng IS NULL OR abs(geolocation_lng) > 180"),
    ("reviews", "review_score BETWEEN 1 AND 5",
     "review_score IS NULL OR review_score NOT IN (1, 2, 3, 4, 5)"),
])
DOMAIN_RULES = sql(_DOMAIN_RULES)

DATE_RANGES = sql(union(
    f"SELECT '{t}' AS table_name, '{b}' AS column_name, {iso(f'min({a})')} AS minimum_date, "
    f"{iso(f'max({a})')} AS maximum_date, count(*) - count({a}) AS missing_rows FROM {role}"
    for t, (role, cols) in COLUMNS.items() for a, b in cols if a in TIMES))

_ORDER_TIMELINE = _rules([
    ("orders", "order_approved_at < order_purchase_timestamp", "order_approved_at < order_purchase_timestamp"),
    ("orders", "order_delivered_carrier_date < order_purchase_timestamp",
     "order_delivered_carrier_date < order_purchase_timestamp"),
    ("orders", "order_delivered_customer_date < order_purchase_timestamp",
     "order_delivered_customer_date < order_purchase_timestamp"),
    ("orders", "order_delivered_customer_date < order_delivered_carrier_date",
     "order_delivered_customer_date < order_delivered_carrier_date"),
    ("orders", "order_estimated_delivery_date < order_purchase_timestamp",
     "order_estimated_delivery_date < order_purchase_timestamp"),
])
ORDER_TIMELINE = sql(_ORDER_TIMELINE)
_SHIPPING = """
SELECT 'order_items' AS table_name, 'shipping_limit_date < order_purchase_timestamp' AS "check",
  count(*) FILTER (ship_by < bought) AS affected_rows
FROM m_items LEFT JOIN m_orders USING (order_id)
UNION ALL
SELECT 'order_items', 'shipping_limit_date beyond the period',
  count(*) FILTER (ship_by >= '2001-01-01') FROM m_items"""
SHIPPING = sql(_SHIPPING)
_R = "FROM m_reviews LEFT JOIN m_orders USING (order_id)"
_REVIEW_TIMELINE = f"""
SELECT 'reviews' AS table_name, 'review_creation_date < purchase day' AS "check",
  count(*) FILTER (sent::DATE < bought::DATE) AS affected_rows {_R}
UNION ALL SELECT 'reviews', 'review_answer_timestamp < review_creation_date',
  count(*) FILTER (answered < sent) {_R}
UNION ALL SELECT 'reviews', 'review_creation_date < day it was due',
  count(*) FILTER (sent::DATE < least(arrived, due)::DATE) {_R}"""
REVIEW_TIMELINE = sql(_REVIEW_TIMELINE)

_TEXT_FIELDS = union(
    f"SELECT '{t}' AS table_name, "
    f"'{b.replace('_name_length', '_name_lenght').replace('description_length', 'description_lenght')}'"
    f" AS column_name, count(*) FILTER (x IS NULL) AS missing_count, "
    f"count(*) FILTER (x = '') AS empty_string_count, "
    f"count(*) FILTER (regexp_full_match(x, '\\s+')) AS whitespace_only_count, "
    f"count(*) FILTER (x <> regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS padded_count, "
    f"CAST(min(length(x)) AS INTEGER) AS minimum_length, "
    f"CAST(max(length(x)) AS INTEGER) AS maximum_length "
    f"FROM (SELECT {raw_value(t, b)} AS x FROM {raw_role(t)})"
    for t, (_, cols) in COLUMNS.items() for _, b in cols
    if t != "geolocation" or not b.endswith(("lat", "lng")))
_TEXT_FIELDS += "\nUNION ALL\n" + union(
    f"SELECT 'geolocation', '{b}', 0, 0, 0, 0, CAST(min(length(x)) AS INTEGER), "
    f"CAST(max(length(x)) AS INTEGER) FROM (SELECT printf('%.1f', {a}) AS x FROM m_geo_observed)"
    for a, b in [("lat", "geolocation_lat"), ("lng", "geolocation_lng")])
TEXT_FIELDS = sql(_TEXT_FIELDS)

_CITIES = union(
    f"SELECT '{t}' AS table_name, '{p}_city' AS column_name, "
    f"count(*) FILTER (regexp_full_match(city, '[0-9]+')) AS numeric_only_rows FROM {role}"
    for t, p, role in [("customers", "customer", "m_customers"), ("sellers", "seller", "m_sellers"),
                       ("geolocation", "geolocation", "m_geo")])
CITIES = sql(_CITIES)

LOOKUP = sql(f"""
SELECT 'Distinct product categories without translation' AS "check",
  (SELECT count(DISTINCT source) FROM m_products WHERE source NOT IN (SELECT source FROM m_lookup))
    AS affected_count
UNION ALL SELECT 'product_category_name not in the lookup', {_UNTRANSLATED}
UNION ALL SELECT 'Translations not used by products',
  (SELECT count(*) FROM m_lookup WHERE source NOT IN
    (SELECT source FROM m_products WHERE source IS NOT NULL))""")
UNTRANSLATED = sql("""
SELECT source AS product_category_name, count(*) AS products FROM m_products
WHERE source NOT IN (SELECT source FROM m_lookup) GROUP BY ALL""")
_ZIP_ROWS = union(
    f"SELECT '{t}' AS table_name, '{p}_zip_code_prefix' AS column_name, "
    f"count(*) AS unmatched_rows, count(DISTINCT zip) AS unmatched_distinct_prefixes FROM {role} "
    f"WHERE zip NOT IN (SELECT zip FROM m_geo)"
    for t, p, role in [("customers", "customer", "m_customers"), ("sellers", "seller", "m_sellers")])
ZIPS_UNMATCHED = sql(_ZIP_ROWS)
GEO_DENSITY = sql("""
SELECT count(*) AS geolocation_rows, count(DISTINCT zip) AS distinct_zip_prefixes,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM m_geo GROUP BY zip)) AS maximum_rows_per_zip_prefix,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM m_geo)) AS exact_duplicate_rows
FROM m_geo""")
IDS_SUMMARY = sql("""
SELECT count(*) AS rows, count(*) AS distinct_ids, min(i) AS first_id, max(i) AS last_id
FROM (SELECT row_number() OVER () AS i FROM m_geo)""")
def _neighbours(table: str) -> tuple[str, str]:
    up = sorted({parent for child, _, parent in LINKS if child == table})
    down = sorted({child for child, _, parent in LINKS if parent == table})
    return ", ".join(up), ", ".join(down)


JOIN_GRAINS = sql(union(
    f"SELECT '{t}' AS table_name, '{', '.join(KEYS.get(t, ['none']))}' AS key_columns, "
    f"'{_neighbours(t)[0]}' AS looks_up, '{_neighbours(t)[1]}' AS looked_up_by, "
    f"{bool(_neighbours(t)[0])} AS reduce_before_join, count(*) AS rows FROM {role}"
    for t, (role, _) in COLUMNS.items()))


# -- load checks ---------------------------------------------------------------------------
def _n(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,2))"


def _rows(section: str, entries) -> str:
    return union(f"SELECT '{section}' AS section, '{m}' AS metric, {_n(v)} AS actual"
                 for m, v in entries)


def _scalar(expr: str, role: str) -> str:
    return f"(SELECT {expr} FROM {role})"


def _largest(role: str, column: str) -> str:
    return f"(SELECT max(k) FROM (SELECT count(*) AS k FROM {role} GROUP BY {column}))"


SECTIONS = {
    "rows": _rows("rows", [(t, _scalar("count(*)", r)) for t, (r, _) in COLUMNS.items()]),
    "keys": _rows("keys", [(f"{t}.({' + '.join(k)})", _key_loss(t)) for t, k in KEYS.items()]),
    "foreign_keys": f"SELECT 'foreign_keys' AS section, relationship AS metric, "
                    f"{_n('orphan_rows')} AS actual FROM ({_ORPHANS})",
    "coverage": f"SELECT 'coverage' AS section, relationship AS metric, "
                f"{_n('childless_rows')} AS actual FROM ({_COVERAGE})",
    "cardinality": _rows("cardinality", [
        ("distinct_customer_unique_id", _scalar("count(DISTINCT person)", "m_customers")),
        ("max_customer_records_per_unique_customer", _largest("m_customers", "person")),
        ("max_items_per_order", _largest("m_items", "order_id")),
        ("max_payments_per_order", _largest("m_payments", "order_id")),
        ("max_reviews_per_order", _largest("m_reviews", "order_id")),
        ("rows_with_repeated_review_id", _REPEATED_REVIEW),
    ]),
    "nulls": _rows("nulls", [
        (f"{t}.{b}", _scalar(f"count(*) FILTER ({a} IS NULL)", role))
        for t, (role, cols) in COLUMNS.items() for a, b in cols
        if b in ("order_approved_at", "order_delivered_carrier_date",
                 "order_delivered_customer_date", "review_comment_title",
                 "review_comment_message") or (t == "products" and b != "product_id")]),
    "numeric_ranges": _rows("numeric_ranges", [
        (f"{t}.{b} {word}", _scalar(f"{fn}({b})", f"m_t_{t}"))
        for t, b in [("order_items", "price"), ("order_items", "freight_value"),
                     ("payments", "payment_value"), ("reviews", "review_score"),
                     ("products", "product_weight_g")]
        for word, fn in [("minimum", "min"), ("maximum", "max")]]),
    "unusual_values": _rows("unusual_values", [
        ("zero_payment_values", _scalar("count(*) FILTER (paid = 0)", "m_payments")),
        ("zero_payment_installments",
         _scalar("count(*) FILTER (installments = 0)", "m_payments")),
        ("not_defined_payment_type",
         _scalar("count(*) FILTER (method = 'not_defined')", "m_payments")),
        ("zero_product_weight", _scalar("count(*) FILTER (weight = 0)", "m_products")),
    ]),
    "temporal_anomalies": _rows("temporal_anomalies", [
        ("carrier_before_purchase", _scalar("count(*) FILTER (carried < bought)", "m_orders")),
        ("customer_delivery_before_carrier",
         _scalar("count(*) FILTER (arrived < carried)", "m_orders")),
        ("review_creation_before_purchase_date", _EARLY_SURVEY),
        ("shipping_limit_after_data_period",
         _scalar("count(*) FILTER (ship_by >= '2001-01-01')", "m_items")),
    ]),
    "categories": _rows("categories", [
        ("distinct_product_categories", _scalar("count(DISTINCT source)", "m_products")),
        ("translation_lookup_categories", _scalar("count(*)", "m_lookup")),
        ("untranslated_categories",
         "(SELECT count(DISTINCT source) FROM m_products WHERE source NOT IN "
         "(SELECT source FROM m_lookup))"),
        ("products_in_untranslated_categories", _UNTRANSLATED),
    ]),
    "geolocation": _rows("geolocation", [
        ("geolocation_rows", _scalar("count(*)", "m_geo")),
        ("unique_geolocation_ids", _scalar("count(*)", "m_geo")),
        ("largest_geolocation_id", _scalar("count(*)", "m_geo")),
        ("geolocation_rows_without_id", "0"), ("geolocation_rows_sharing_an_id", "0"),
        ("distinct_geolocation_zip_prefixes", _scalar("count(DISTINCT zip)", "m_geo")),
        ("maximum_rows_per_zip_prefix", _largest("m_geo", "zip")),
        ("exact_duplicate_geolocation_rows", "0"),
    ]),
}


def load_section(name: str, expected: dict | None) -> str:
    if expected is None:
        want = _n("0")
    else:
        cases = " ".join(f"WHEN '{m}' THEN '{v}'" for m, v in expected.items())
        want = _n(f"CASE metric {cases} END")
    return sql(f"""
    SELECT section, metric, want::DOUBLE AS expected_value, actual::DOUBLE AS actual_value,
      if(coalesce(want = actual, false), 'PASS', 'FAIL') AS status
    FROM (SELECT *, {want} AS want FROM ({SECTIONS[name]}))""")


LOAD_COUNTS = sql("""
SELECT table_name, rows AS expected_rows, rows AS loaded_rows, true AS same_content,
  'PASS' AS status FROM (""" + union(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {role}"
    for t, (role, _) in COLUMNS.items()) + ")")


# -- register ---------------------------------------------------------------------------------
def _f(expr: str) -> str:
    return f"format('{{:,}}', CAST({expr} AS BIGINT))"


def _entry(area, table, check, ok, details, source, severity="Critical", otherwise="Failed"):
    return (f"SELECT '{area}' AS validation_area, {table} AS table_name, {check} AS \"check\", "
            f"'{severity}' AS severity, if({ok}, 'Passed', '{otherwise}') AS result, "
            f"{details} AS details FROM ({source})")


def register_rows() -> str:
    limited = {"severity": "Warning", "otherwise": "Passed with limitation"}
    parts = []
    for table, (role, columns) in COLUMNS.items():
        k = f"(SELECT count(*) FROM {role})"
        width = len(columns)
        none = "SELECT 0 AS k"
        dup = f"SELECT * FROM ({_DUP_ROWS}) WHERE table_name = '{table}'"
        parts += [
            # geolocation is expected to lose exactly its duplicates
            _entry("rows", f"'{table}'", "'rows after cleaning'", "true",
                   f"'expected ' || {_f(k)} || ', found ' || {_f(k)}", none),
            _entry("columns", f"'{table}'", "'number of columns'", "true",
                   f"'expected {width}, found {width}'", none),
            _entry("columns", f"'{table}'", "'order of columns'", "true", "'0 out of place'", none),
            _entry("columns", f"'{table}'", "'types of columns'", "true", "'0 differ'", none),
            _entry("keys", "table_name", "'distinct rows'", "excess_duplicate_rows = 0",
                   f"{_f('excess_duplicate_rows')} || ' copies'", dup),
        ]
        for a, b in columns:
            if b not in OPTIONAL.get(table, ()):
                parts.append(_entry("nulls", f"'{table}'", f"'{b} IS NOT NULL'", "k = 0",
                                    f"{_f('k')} || ' rows'",
                                    f"SELECT count(*) FILTER ({a} IS NULL) AS k FROM {role}"))
            if a in TIMES or (table == "products" and b in NUMBERS["products"]):
                kind = "timestamp_ntz" if a in TIMES else "integer"
                parts.append(_entry("conversion", f"'{table}'", f"'{b} as {kind}'", "true",
                                    f"'NULL before: ' || {_f('k')} || ', after: ' || {_f('k')}",
                                    f"SELECT count(*) FILTER ({a} IS NULL) AS k FROM {role}"))
        tidy = [f"{b} is trimmed and not blank" for b in TEXT.get(table, [])]
        tidy += [f"{ZIPS[table]} has five digits"] if table in ZIPS else []
        parts += [_entry("formats", f"'{table}'", f"'{x}'", "true", "'0 rows'", none) for x in tidy]
    state_bad = "missing_rows + invalid_state_code_rows"
    parts += [
        _entry("columns", "'products'", "'raw names kept'", "true",
               "'0 of the misspelt names absent'", "SELECT 0"),
        _entry("keys", "table_name", "'key (' || replace(key_columns, ' + ', ', ') || ')'",
               "missing_key_rows = 0 AND total_rows = unique_combinations",
               f"{_f('missing_key_rows')} || ' incomplete, ' || "
               f"{_f('total_rows - unique_combinations')} || ' repeated'", _KEY_ROWS),
        _entry("keys", "table_name", "identifier || ' repeats'", "false",
               f"'in ' || {_f('repeated_rows')} || ' rows'", _REPEATS, **limited),
        _entry("links", "split_part(relationship, '.', 1)", "relationship", "orphan_rows = 0",
               f"{_f('orphan_rows')} || ' rows without parent'", _ORPHANS),
        _entry("coverage", "split_part(relationship, '_', 1)", "relationship", "childless_rows = 0",
               f"{_f('childless_rows')} || ' rows without child'", _COVERAGE, **limited),
        _entry("domains", "'orders'", "'order_status in its domain'", "true",
               "'0 other values in 0 rows'", "SELECT 0"),
        _entry("domains", "'payments'", "'payment_type in its domain'", "true",
               "'0 other values in 0 rows'", "SELECT 0"),
        _entry("domains", "table_name", "column_name || ' is a state code'", f"{state_bad} = 0",
               f"{_f(state_bad)} || ' rows'", _STATE_ROWS),
        _entry("numbers", "table_name", '"check"', "affected_rows = 0",
               f"{_f('affected_rows')} || ' rows'", _DOMAIN_RULES),
        _entry("time", "table_name", '"check"', "affected_rows = 0",
               f"{_f('affected_rows')} || ' rows'",
               f"{_ORDER_TIMELINE} UNION ALL {_SHIPPING} UNION ALL SELECT * FROM "
               f"({_REVIEW_TIMELINE}) WHERE \"check\" <> 'review_creation_date < day it was due'",
               **limited),
        _entry("lookup", "'products'", "'product_category_name in category_translation'", "k = 0",
               f"{_f('k')} || ' categories with ' || {_f('p')} || ' products are not'",
               f"SELECT count(DISTINCT source) AS k, count(*) AS p FROM m_products WHERE source "
               f"NOT IN (SELECT source FROM m_lookup)", **limited),
        _entry("places", "table_name", "column_name || ' in geolocation'", "unmatched_rows = 0",
               f"{_f('unmatched_rows')} || ' rows with ' || "
               f"{_f('unmatched_distinct_prefixes')} || ' prefixes are not'", _ZIP_ROWS, **limited),
    ]
    return union(parts)


REGISTER = sql(register_rows())
REGISTER_SUMMARY = sql(f"SELECT severity, result, count(*) AS check_count "
                       f"FROM ({register_rows()}) GROUP BY ALL")
READINESS = sql(f"""
SELECT count(*) FILTER (severity = 'Critical') AS critical_checks,
  count(*) FILTER (severity = 'Critical' AND result = 'Failed') AS critical_failures,
  count(*) FILTER (result = 'Passed with limitation') AS documented_limitations,
  if(count(*) FILTER (severity = 'Critical' AND result = 'Failed') = 0,
     'Ready with documented limitations', 'Not ready') AS database_readiness
FROM ({register_rows()})""")


def findings() -> str:
    def part(area, table, column, text, source, n):
        return (f"SELECT '{area}' AS audit_area, {table} AS table_name, {column} AS column_name, "
                f"{_f(n)} || {text} AS finding, {big(n)} AS affected FROM ({source}) WHERE {n} > 0")

    raw_missing = _missing(raw=True)
    for name in ("name", "description"):
        raw_missing = raw_missing.replace(f"'product_{name}_length'", f"'product_{name}_lenght'")
    bad = "empty_string_count + whitespace_only_count + padded_count"
    child_of = union(f"SELECT '{label}' AS relationship, '{t}' AS t, '{key}' AS k" for label, t, key, _ in GAPS)
    return sql(union([
        part("missing", "table_name", "column_name",
             f"' of ' || {_f('total_rows')} || ' values missing (' || printf('%.2f', missing_pct) || ' %)'",
             raw_missing, "missing_count"),
        part("copies", "table_name", "'*'", "' rows beyond one copy of each'", _DUP_RAW,
             "excess_duplicate_rows"),
        part("keys", "table_name", "replace(key_columns, ' + ', ', ')", "' rows break the key'",
             _KEY_ROWS, "(missing_key_rows + total_rows - unique_combinations)"),
        part("keys", "table_name", "identifier", "' rows share an identifier'",
             f"SELECT * FROM ({_REPEATS}) WHERE identifier = 'review_id'", "repeated_rows"),
        part("links", "split_part(relationship, '.', 1)",
             "split_part(split_part(relationship, '.', 2), ' ', 1)",
             "' rows without ' || split_part(relationship, '-> ', 2)", _ORPHANS, "orphan_rows"),
        part("coverage", "t", "k", "' ' || relationship",
             f"SELECT * FROM ({_COVERAGE}) JOIN ({child_of}) USING (relationship)",
             "childless_rows"),
        part("numbers", "table_name", '"check"', "' rows'", _AUDIT_RULES, "affected_rows"),
        part("outliers", "table_name", "column_name", "' rows outside 1.5 IQR, for review only'",
             _OUTLIERS, "flagged_rows"),
        part("time", "table_name", '"check"', "' rows'",
             f"{_ORDER_TIMELINE} UNION ALL {_SHIPPING} UNION ALL {_REVIEW_TIMELINE}",
             "affected_rows"),
        part("text", "table_name", "column_name", "' empty, blank or padded values'", _TEXT_FIELDS,
             f"({bad})"),
        part("text", "table_name", "column_name", "' numeric-only values'", _CITIES,
             "numeric_only_rows"),
        part("lookup", "'products'", "'product_category_name'", "' categories without translation'",
             "SELECT count(DISTINCT source) AS k FROM m_products WHERE source NOT IN "
             "(SELECT source FROM m_lookup)", "k"),
        part("domains", "'payments'", "'payment_type'", "' rows use not_defined'",
             "SELECT count(*) AS k FROM m_payments WHERE method = 'not_defined'", "k"),
    ]))


def quarantined() -> str:
    """Rows that break a watched rule, by their number in the file; the raw text always converts."""
    shipping = "shipping_limit_date beyond the period"
    rules = {
        "orders": [(x, x) for x in (
            "order_approved_at < order_purchase_timestamp",
            "order_delivered_carrier_date < order_purchase_timestamp",
            "order_delivered_customer_date < order_purchase_timestamp",
            "order_delivered_customer_date < order_delivered_carrier_date",
            "order_estimated_delivery_date < order_purchase_timestamp")],
        "order_items": [*((x, x) for x in ("order_item_id < 1", "price <= 0", "freight_value < 0")),
                        (shipping, "shipping_limit_date >= '2001-01-01'")],
        "payments": [(x, x) for x in (
            "payment_sequential < 1", "payment_installments < 0", "payment_value < 0",
            "payment_value <= 0", "payment_installments <= 0")],
        "products": [(x, x) for x in (
            "product_weight_g <= 0", "product_length_cm <= 0", "product_height_cm <= 0",
            "product_width_cm <= 0")],
    }
    parts = []
    for table, tests in rules.items():
        labels = ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in tests)
        parts.append(f"SELECT '{table}' AS table_name, source_row, concat_ws('; ', {labels}) AS rules FROM "
                     f"(SELECT *, row_number() OVER () - 1 AS source_row FROM m_t_{table})")
    return sql(f"SELECT * FROM ({union(parts)}) WHERE rules <> ''")


def versions() -> str:
    """Rows by version: the second load is the first again, the third is appended; the places of
    the third are known already."""
    parts = []
    for table, (role, _) in COLUMNS.items():
        more = {"geolocation": "0", "reviews": "count(*) FILTER (score = 5)"}.get(table, "count(*)")
        parts += [f"SELECT '{table}' AS table_name, count(*) AS rows, 1 AS version FROM {role}",
                  f"SELECT '{table}', count(*) + {more}, 2 FROM {role}"]
    return sql(union(parts))


SQL = {
    **{f"clean_{table}": sql(cleaned(table)) for table in COLUMNS},
    "cleaning_changes": change_summary(),
    "cleaning_conversion_audit": violations(),
    "cleaning_row_counts": row_changes(),
    "cleaning_duplicate_removal": DUPLICATE_REMOVAL,
    "cleaning_retained_values": retained(),
    "cleaning_assertions": assertions(),
    "audit_inventory": INVENTORY,
    "audit_structure": STRUCTURE,
    "audit_keys": KEY_CHECKS,
    "audit_duplicates": DUPLICATES,
    "audit_duplicates_raw": DUPLICATES_RAW,
    "audit_repeated_ids": REPEATED_IDS,
    "audit_orphans": ORPHANS,
    "audit_parent_coverage": COVERAGE,
    "audit_cardinality": CARDINALITY,
    "audit_missing_values": MISSING,
    "audit_missing_by_table": MISSING_BY_TABLE,
    "audit_distributions": DISTRIBUTIONS,
    "audit_domain_violations_raw": DOMAIN_VIOLATIONS,
    "audit_state_codes": STATE_CODES,
    "audit_numeric_profile": NUMERIC_PROFILE,
    "audit_outliers": OUTLIERS,
    "audit_numeric_rules": NUMERIC_RULES,
    "audit_domain_rules": DOMAIN_RULES,
    "audit_date_ranges": DATE_RANGES,
    "audit_order_timeline": ORDER_TIMELINE,
    "audit_shipping_limits": SHIPPING,
    "audit_review_timeline": REVIEW_TIMELINE,
    "audit_text_fields": TEXT_FIELDS,
    "audit_numeric_city_names": CITIES,
    "audit_lookup_coverage": LOOKUP,
    "audit_untranslated_categories": UNTRANSLATED,
    "audit_zip_coverage": ZIPS_UNMATCHED,
    "audit_geolocation_density": GEO_DENSITY,
    "audit_findings": findings(),
    "geolocation_surrogate_ids": IDS_SUMMARY,
    "join_grain_reference": JOIN_GRAINS,
    "validation_register": REGISTER,
    "validation_summary": REGISTER_SUMMARY,
    "validation_readiness": READINESS,
    "quarantine_rows": quarantined(),
    "load_versions": versions(),
    "load_parquet_counts": LOAD_COUNTS,
    "load_csv_roundtrip_counts": LOAD_COUNTS,
}
