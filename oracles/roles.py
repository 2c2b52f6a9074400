"""DuckDB side of the role bindings: the marketplace tables as CTEs over the given views."""

from __future__ import annotations

import re

ROLES = {
    "m_orders": """
    SELECT o_orderkey AS order_id, o_custkey AS customer_id,
           CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                              WHEN 'P' THEN 'canceled' END AS order_status,
           o_orderdate AS bought,
           CASE WHEN o_orderkey % 97 <> 0
                THEN o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 40 - 1) END AS approved,
           CASE WHEN o_orderkey % 75 <> 0
                THEN o_orderdate + INTERVAL 1 HOUR * (o_orderkey * 31 % 400 - 2) END AS carried,
           CASE WHEN o_orderkey % 50 <> 0
                THEN o_orderdate + INTERVAL 60 DAY
                     + INTERVAL 1 HOUR * (o_orderkey * 7919 % 2000 - 1100) END AS arrived,
           o_orderdate + INTERVAL 60 DAY AS due
    FROM orders""",
    "m_items": """
    SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
           l_suppkey AS seller_id, l_shipdate AS ship_by,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
           CAST((CAST(round(l_extendedprice * 100) AS BIGINT)
                 * CAST(round(l_tax * 100) AS BIGINT) + 50) // 100 AS DECIMAL(14,0)) / 100
             AS freight_raw
    FROM lineitem""",
    "m_customers": """
    SELECT c_custkey AS customer_id,
           CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS person,
           lpad(CAST(c_custkey * 37 % 1200 AS VARCHAR), 5, '0') AS zip,
           lower(c_mktsegment) AS city, n_name AS state
    FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "m_sellers": """
    SELECT s_suppkey AS seller_id, lpad(CAST(s_suppkey * 53 % 1200 AS VARCHAR), 5, '0') AS zip,
           CASE WHEN s_suppkey % 17 = 0 THEN CAST(s_suppkey AS VARCHAR)
                ELSE 'city ' || s_nationkey END AS city,
           n_name AS state
    FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "m_products": """
    SELECT p_partkey AS product_id,
           CASE WHEN p_brand <> 'Brand#1' THEN p_type END AS source,
           CASE WHEN p_brand <> 'Brand#1' THEN length(p_name) END AS name_length,
           CASE WHEN p_brand <> 'Brand#1' THEN length(p_name) * p_size END AS description_length,
           CASE WHEN p_brand <> 'Brand#1' THEN p_size % 6 END AS photos,
           CASE WHEN p_partkey % 50 <> 0
                THEN CASE WHEN p_size % 25 = 0 THEN 0 ELSE p_size * 150 END END AS weight,
           CASE WHEN p_partkey % 50 <> 0 THEN p_size + 10 END AS len,
           CASE WHEN p_partkey % 50 <> 0 THEN p_size * p_size % 90 + 2 END AS height,
           CASE WHEN p_partkey % 50 <> 0 THEN p_partkey % 60 + 6 END AS width
    FROM part""",
    "m_lookup": """
    SELECT DISTINCT source, lower(source) || '_goods' AS english
    FROM (SELECT unnest([p_type, 'UNUSED']) AS source FROM part WHERE p_type <> 'PROMO')""",
    "m_payments": """
    SELECT l_orderkey AS order_id, l_linenumber AS seq,
           CASE l_returnflag WHEN 'R' THEN 'credit_card' WHEN 'A' THEN 'boleto'
                             WHEN 'N' THEN 'voucher' END AS method,
           CAST(l_quantity AS INTEGER) % 14 AS installments,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS paid
    FROM lineitem""",
    "m_reviews": """
    SELECT event_id AS review_id, event_id // 2 * 3 AS order_id,
           1 + CAST(floor(value) AS INTEGER) % 5 AS score,
           CASE WHEN event_id % 3 = 0 THEN event_type END AS title,
           CASE WHEN event_id % 2 = 0 THEN props END AS message,
           CAST(date_trunc('day', ts) + INTERVAL 1 DAY * (event_id % 9 - 7) AS TIMESTAMP) AS sent,
           CAST(date_trunc('second', ts) AS TIMESTAMP) AS answered
    FROM events""",
    "m_geo_observed": """
    SELECT lpad(CAST(c_custkey * 37 % 1200 + CASE WHEN c_custkey % 8 = 0 THEN 5000 ELSE 0 END
                     AS VARCHAR), 5, '0') AS zip,
           CAST(-(c_custkey % 33) AS DOUBLE) AS lat,
           CAST(-(c_custkey % 70) AS DOUBLE) - 0.5::DOUBLE AS lng,
           lower(c_mktsegment) AS city, n_name AS state
    FROM customer JOIN nation ON n_nationkey = c_nationkey
    JOIN (VALUES (1), (2)) copies(n) ON n = 1 OR c_custkey % 5 = 0""",
    "m_geo": "SELECT DISTINCT * FROM m_geo_observed",
    # -- derived roles ------------------------------------------------------------
    "m_done": "SELECT * FROM m_orders WHERE order_status = 'delivered'",
    "m_baskets": """
    SELECT order_id, count(*) AS n, sum(price) AS sales, sum(freight_raw) AS freight
    FROM m_items GROUP BY ALL""",
    "m_done_items": """
    SELECT i.*, d.bought, d.customer_id FROM m_items i JOIN m_done d USING (order_id)""",
    "m_labels": """
    SELECT p.product_id, p.source, l.english, coalesce(l.english, p.source, 'unknown') AS label
    FROM m_products p LEFT JOIN m_lookup l USING (source)""",
    "m_eligible": """
    SELECT *, date_diff('second', bought, arrived) AS took,
           date_diff('second', bought, due) AS promised,
           date_diff('second', due, arrived) AS slip
    FROM m_done WHERE arrived IS NOT NULL AND due IS NOT NULL""",
    "m_last_review": """
    SELECT order_id, score FROM m_reviews
    QUALIFY row_number() OVER (PARTITION BY order_id
                               ORDER BY answered DESC, review_id DESC) = 1""",
}


def with_roles(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with exactly the role CTEs it uses, in dependency order."""
    available = {**ROLES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bm_\w+", text):
            if name in available and name not in needed:
                visit(available[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ",\n".join(f"{name} AS ({available[name].strip()})" for name in needed)
    body = body.strip()
    if not head:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def rnd(value: str, digits: int = 2) -> str:
    """Round half up on decimals; DuckDB rounds a double 16.025 down."""
    return f"round(CAST(({value})::DOUBLE AS DECIMAL(30,9)), {digits})::DOUBLE"


def pct(part: str, whole: str) -> str:
    return rnd(f"100.0::DOUBLE * ({part})::DOUBLE / nullif(({whole})::DOUBLE, 0)")


def avg2(num: str, den: str) -> str:
    return rnd(f"({num})::DOUBLE / nullif(({den})::DOUBLE, 0)")


def days2(seconds: str, n: str) -> str:
    return rnd(f"({seconds})::DOUBLE / nullif(({n})::DOUBLE, 0) / 86400")


def money(value: str) -> str:
    return rnd(value)


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


CORE = "bought >= '1996-01-01' AND bought < '1997-09-01'"
MATCHED = "(year(bought) IN (1996, 1997) AND month(bought) <= 8)"
