"""The validation register, its summary and the readiness gate; the audit findings.

All of them are arithmetic on the stored table of ``quality_counts``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarscope.functions import domain as D
from bazaarscope.functions import metrics as M
from bazaarscope.plans import audit as A
from bazaarscope.plans import cleaning as C
from bazaarscope.plans import quality_counts as Q
from bazaarscope.sources.model import SCHEMAS, TABLES, Marketplace

c = F.col


def _advice(table: str) -> tuple[str, str, str, str]:
    """Table, key columns, tables it looks up and tables that refer to it, from the keys."""
    keys = D.PRIMARY_KEYS.get(table, ())
    parents = sorted({parent for child, _, parent, _ in D.FOREIGN_KEYS if child == table})
    children = sorted({child for child, _, parent, _ in D.FOREIGN_KEYS if parent == table})
    return table, ", ".join(keys) or "none", ", ".join(parents), ", ".join(children)


def join_grains(mk: Marketplace) -> DataFrame:
    """Key, neighbours and current size of each table, and whether a join on one of its
    foreign keys alone can repeat rows of the other side."""
    advice = ", ".join(str(_advice(table)) for table in TABLES)
    repeats = {
        child for child, key, _, _ in D.FOREIGN_KEYS if D.PRIMARY_KEYS.get(child) != (key,)
    }
    rows = mk.orders.sparkSession.sql(
        f"SELECT * FROM VALUES {advice} AS v(table_name, key_columns, looks_up, looked_up_by)"
    )
    return rows.join(A.inventory(mk).select("table_name", "rows"), "table_name").withColumn(
        "reduce_before_join", c("table_name").isin(*sorted(repeats))
    )


# a count of the table: topic, item, statistic, and how often it is taken
Term = tuple[str, str, str, int]


@dataclass
class Entry:
    """A line of a report over the counts ``n`` and ``m``, each a sum of terms and a constant.

    ``words`` may name {n}, {m} and {pct}, n per cent of m.
    """

    area: str
    table: str
    check: str
    words: str
    n: Sequence[Term] | int
    m: Sequence[Term] | int = 0
    passes: str = "n = 0"
    severity: str = D.CRITICAL
    otherwise: str = D.FAILED


def _limited(*args, **kwargs) -> Entry:
    """An entry that is noted, not failed."""
    return Entry(*args, severity=D.WARNING, otherwise=D.LIMITED, **kwargs)


def rows_of(topic: str, item: str = "*", factor: int = 1) -> Term:
    return topic, item, "rows", factor


def key_of(topic: str, statistic: str, slot: int = 0, factor: int = 1) -> Term:
    return topic, str(slot), statistic, factor


def _sql(value: str | int) -> str:
    if isinstance(value, int):
        return f"{value}L"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    lines = ", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {lines} AS v({names})")


def _filled(counts: DataFrame, entries: list[Entry]) -> DataFrame:
    """The entries with their counts ``n`` and ``m``; a count that is not there is 0."""
    spark = counts.sparkSession
    terms, lines = [], []
    for i, e in enumerate(entries):
        constant = [x if isinstance(x, int) else 0 for x in (e.n, e.m)]
        lines.append((i, e.area, e.table, e.check, e.words, e.passes, e.severity, e.otherwise, *constant))
        for side, found in (("n", e.n), ("m", e.m)):
            if not isinstance(found, int):
                terms += [(i, side, *term) for term in found]
    wanted = _values(spark, terms, "entry, side, topic, item, statistic, factor")
    sums = wanted.join(counts, ["topic", "item", "statistic"]).groupBy("entry").agg(*(
        F.sum(F.when(c("side") == side, c("n") * c("factor"))).alias(f"{side}_sum") for side in ("n", "m")
    ))
    lines = _values(
        spark, lines, "entry, area, table_name, check, words, passes, severity, otherwise, n_fixed, m_fixed"
    )
    return lines.join(sums, "entry", "left").select(
        "area", "table_name", "check", "words", "passes", "severity", "otherwise",
        *((F.coalesce(f"{side}_sum", F.lit(0)) + c(f"{side}_fixed")).alias(side) for side in ("n", "m")),
    )


def _text() -> Column:
    out = c("words")
    for name, value in (("n", F.format_number("n", 0)), ("m", F.format_number("m", 0)),
                        ("pct", F.coalesce(F.format_number(M.pct(c("n"), c("m")), 2), F.lit("")))):
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


# -- the register ------------------------------------------------------------------------------
def _table_entries(raw: Marketplace, cleaned: Marketplace, table: str) -> list[Entry]:
    source = Q.raw_topic(table)
    typed = f"typed copies of {source}"
    kept = [rows_of(source)]
    if table == "geolocation":  # cleaning keeps one of each
        kept = [key_of(typed, "distinct")]
    declared = [f.name for f in SCHEMAS[table].fields]
    types = {f.name: f.dataType.simpleString() for f in cleaned[table].schema.fields}
    misplaced = sum(cleaned[table].columns[i : i + 1] != [name] for i, name in enumerate(declared))
    mistyped = sum(types.get(f.name) != f.dataType.simpleString() for f in SCHEMAS[table].fields)
    entries = [
        Entry("rows", table, "rows after cleaning", "expected {n}, found {m}", kept, [rows_of(table)], "n = m"),
        Entry("columns", table, "number of columns", "expected {n}, found {m}",
              len(raw[table].columns), len(cleaned[table].columns), "n = m"),
        Entry("columns", table, "order of columns", "{n} out of place", misplaced),
        Entry("columns", table, "types of columns", "{n} differ", mistyped),
        Entry("keys", table, "distinct rows", "{n} copies",
              [key_of(f"copies of {table}", "rows"), key_of(f"copies of {table}", "distinct", factor=-1)]),
    ]
    optional = D.NULLABLE_COLUMNS.get(table, ())
    for name in declared:
        if name not in optional:
            entries.append(Entry("nulls", table, f"{name} IS NOT NULL", "{n} rows", [rows_of(table, Q.null_rule(name))]))
    for label, _ in C.tidy_rules(table):
        entries.append(Entry("formats", table, label, "{n} rows", [rows_of(table, label)]))
    for label, _ in A.domain_rules().get(table, ()):
        entries.append(Entry("numbers", table, label, "{n} rows", [rows_of(table, label)]))
    for field in SCHEMAS[table].fields:
        if C._step(table, field) in ("timestamp", "whole_number"):
            spelt = raw[table].columns[declared.index(field.name)]
            before = rows_of(source, Q.null_rule(spelt))
            after = [before, rows_of(source, Q.failed_rule(field.name))]
            entries.append(Entry("conversion", table, f"{field.name} as {field.dataType.typeName()}",
                                 "NULL before: {n}, after: {m}", [before], after, "n = m"))
    if table in D.STATE_COLUMNS:
        bad = [rows_of(table, "state code missing"), rows_of(table, "state code unknown")]
        entries.append(Entry("domains", table, f"{D.STATE_COLUMNS[table]} is a state code", "{n} rows", bad))
    if table in Q.DOMAINS:
        column = Q.DOMAINS[table][0]
        entries.append(Entry("domains", table, f"{column} in its domain", "{n} other values in {m} rows",
                             [key_of(f"values of {column}", "distinct")], [key_of(f"values of {column}", "rows")]))
    return entries


def _key_terms(table: str) -> tuple[list[Term], list[Term]]:
    """Rows with an incomplete key, and rows beyond the first of each key."""
    keys = D.PRIMARY_KEYS[table]
    topic = f"key of {table}" if len(keys) > 1 else Q.slot_of(table, keys[0])[0]
    repeats = [rows_of(table), key_of(topic, "distinct", factor=-1)]
    return [rows_of(table, Q.incomplete_rule(table))], repeats


def _entries(raw: Marketplace, cleaned: Marketplace, shipping_limit_from: str) -> list[Entry]:
    out = [e for table in TABLES for e in _table_entries(raw, cleaned, table)]
    out.append(Entry("columns", "products", "raw names kept", "{n} of the misspelt names absent",
                     sum(name not in raw.products.columns for name in D.RENAMED_COLUMNS)))
    for table, keys in D.PRIMARY_KEYS.items():
        incomplete, repeats = _key_terms(table)
        out.append(Entry("keys", table, f"key ({', '.join(keys)})", "{n} incomplete, {m} repeated",
                         incomplete, repeats, "n + m = 0"))
    for table, name in Q.OWN_IDS.items():
        out.append(_limited("keys", table, f"{name} repeats", "in {n} rows", [key_of(name, "repeated_rows")],
                            passes="false"))
    for child, key, parent, _ in D.FOREIGN_KEYS:
        topic, slot = Q.slot_of(child, key)
        out.append(Entry("links", child, f"{child}.{key} -> {parent}", "{n} rows without parent",
                         [key_of(topic, "orphan_rows", slot)]))
    for label, parent, _, child, key in D.PARENT_COVERAGE:
        topic, slot = Q.slot_of(child, key)
        out.append(_limited("coverage", parent, label, "{n} rows without child", [key_of(topic, "childless", slot)]))
    for label, _ in A.order_timeline_rules():
        out.append(_limited("time", "orders", label, "{n} rows", [rows_of("orders", label)]))
    for label, _ in A.shipping_rules(shipping_limit_from):
        out.append(_limited("time", "order_items", label, "{n} rows", [rows_of(Q.BESIDE_ORDERS, label)]))
    for label, _ in A.review_rules()[:2]:
        out.append(_limited("time", "reviews", label, "{n} rows", [rows_of(Q.BESIDE_ORDERS, label)]))
    topic, slot = Q.slot_of("products", "product_category_name")
    out.append(_limited("lookup", "products", "product_category_name in category_translation",
                        "{n} categories with {m} products are not",
                        [key_of(topic, "orphans", slot)], [key_of(topic, "orphan_rows", slot)]))
    for table in ("customers", "sellers"):
        column = D.ZIP_COLUMNS[table]
        topic, slot = Q.slot_of(table, column)
        missing = [key_of(topic, "orphan_rows", slot), rows_of(table, Q.null_rule(column))]
        out.append(_limited("places", table, f"{column} in geolocation", "{n} rows with {m} prefixes are not",
                            missing, [key_of(topic, "orphans", slot)]))
    return out


def register_of(
    counts: DataFrame, raw: Marketplace, cleaned: Marketplace, shipping_limit_from: str = "2019-01-01"
) -> DataFrame:
    """The register from counts; of the tables only names and types are looked at."""
    rows = _filled(counts, _entries(raw, cleaned, shipping_limit_from))
    ok = F.lit(False)
    for test in ("n = 0", "n = m", "n + m = 0"):
        ok = F.when(c("passes") == test, F.expr(test)).otherwise(ok)
    return rows.select(
        c("area").alias("validation_area"),
        "table_name",
        "check",
        "severity",
        F.when(ok, D.PASSED).otherwise(c("otherwise")).alias("result"),
        _text().alias("details"),
    )


def register(
    raw: Marketplace,
    cleaned: Marketplace,
    shipping_limit_from: str = "2019-01-01",
    states: Sequence[str] = D.STATE_CODES,
) -> DataFrame:
    """All validation results in long form; some 200 rows whatever the data size.

    The counts are made and stored first; readers of several reports do that once, with
    ``quality_counts.store``, and use ``register_of`` and ``findings_of``.
    """
    return register_of(Q.counts(raw, cleaned, shipping_limit_from, states), raw, cleaned, shipping_limit_from)


def in_report_order(entries: DataFrame) -> DataFrame:
    """Critical first, failures first."""
    result = F.when(c("result") == D.FAILED, 0).when(c("result") == D.LIMITED, 1).otherwise(2)
    return entries.orderBy("severity", result, "validation_area", "table_name", "check")


def summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("severity", "result").agg(F.count("*").alias("check_count"))


def readiness(entries: DataFrame) -> DataFrame:
    """One row: ready unless a critical check failed."""
    critical = c("severity") == D.CRITICAL
    row = entries.agg(
        F.count_if(critical).alias("critical_checks"),
        F.count_if(critical & (c("result") == D.FAILED)).alias("critical_failures"),
        F.count_if(c("result") == D.LIMITED).alias("documented_limitations"),
    )
    ready = F.when(c("critical_failures") == 0, D.READY)
    return row.withColumn("database_readiness", ready.otherwise(D.NOT_READY))


def require_ready(entries: DataFrame) -> None:
    """Raise with the failed critical checks; the register itself is small."""
    failed = entries.filter((c("severity") == D.CRITICAL) & (c("result") == D.FAILED)).collect()
    if failed:
        raise AssertionError([f"{r.table_name}: {r.check}: {r.details}" for r in failed])


# -- findings of the audit ---------------------------------------------------------------------
def _findings(raw: Marketplace, shipping_limit_from: str) -> list[Entry]:
    """``check`` holds the column the finding is about."""
    out = []
    for table in TABLES:
        source = Q.raw_topic(table)
        for name in raw[table].columns:
            out.append(Entry("missing", table, name, "{n} of {m} values missing ({pct} %)",
                             [rows_of(source, Q.null_rule(name))], [rows_of(source)]))
            untidy = [rows_of(source, label) for label in Q.text_labels(name)]
            out.append(Entry("text", table, name, "{n} empty, blank or padded values", untidy))
        for field in SCHEMAS[table].fields:
            if C._may_fail(table, field):
                out.append(Entry("conversion", table, field.name, "{n} values do not convert",
                                 [rows_of(source, Q.failed_rule(field.name))]))
        copies = f"copies of {source}"
        out.append(Entry("copies", table, "*", "{n} rows beyond one copy of each",
                         [key_of(copies, "rows"), key_of(copies, "distinct", factor=-1)]))
    for table, keys in D.PRIMARY_KEYS.items():
        incomplete, repeats = _key_terms(table)
        out.append(Entry("keys", table, ", ".join(keys), "{n} rows break the key", [*incomplete, *repeats]))
    out.append(Entry("keys", "reviews", "review_id", "{n} rows share an identifier",
                     [key_of("review_id", "repeated_rows")]))
    for child, key, parent, _ in D.FOREIGN_KEYS:
        topic, slot = Q.slot_of(child, key)
        out.append(Entry("links", child, key, f"{{n}} rows without {parent}", [key_of(topic, "orphan_rows", slot)]))
    for label, parent, _, child, key in D.PARENT_COVERAGE:
        topic, slot = Q.slot_of(child, key)
        out.append(Entry("coverage", parent, key, f"{{n}} {label}", [key_of(topic, "childless", slot)]))
    for table, rules in A.audit_rules().items():
        out += [Entry("numbers", table, label, "{n} rows", [rows_of(table, label)]) for label, _ in rules]
    for table, names in D.OUTLIER_COLUMNS.items():
        out += [Entry("outliers", table, name, "{n} rows outside 1.5 IQR, for review only",
                      [(f"{table}.{name}", "*", "outliers", 1)]) for name in names]
    timed = (
        ("orders", "orders", A.order_timeline_rules()),
        ("order_items", Q.BESIDE_ORDERS, A.shipping_rules(shipping_limit_from)),
        ("reviews", Q.BESIDE_ORDERS, A.review_rules()),
    )
    for table, topic, rules in timed:
        out += [Entry("time", table, label, "{n} rows", [rows_of(topic, label)]) for label, _ in rules]
    for table, column in D.CITY_COLUMNS.items():
        out.append(Entry("text", table, column, "{n} numeric-only values", [rows_of(table, "numeric city")]))
    topic, slot = Q.slot_of("products", "product_category_name")
    out.append(Entry("lookup", "products", "product_category_name", "{n} categories without translation",
                     [key_of(topic, "orphans", slot)]))
    out.append(Entry("domains", "payments", "payment_type", "{n} rows use not_defined",
                     [rows_of("payments", "payment_type = not_defined")]))
    return out


def findings_of(counts: DataFrame, raw: Marketplace, shipping_limit_from: str) -> DataFrame:
    """What the audit of the raw data would have somebody look at.

    Text, gaps and conversions are judged on the raw tables; keys, numbers and time on
    their typed values.
    """
    rows = _filled(counts, _findings(raw, shipping_limit_from)).where(c("n") > 0)
    return rows.select(
        c("area").alias("audit_area"), "table_name", c("check").alias("column_name"), _text().alias("finding"),
        c("n").alias("affected"),
    )


def findings(raw: Marketplace, cleaned: Marketplace, shipping_limit_from: str) -> DataFrame:
    return findings_of(Q.counts(raw, cleaned, shipping_limit_from), raw, shipping_limit_from)
