"""Entry points of the check tool: flagship query, all queries, and their DuckDB oracles."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bazaarscope.functions.metrics import rounded  # noqa: E402
from bazaarscope.operators.profile import union_all  # noqa: E402
from bazaarscope.plans import audit, categories, cleaning, customers, delivery  # noqa: E402
from bazaarscope.plans import facts, load_checks, marketplace, measure_checks, measures, payments  # noqa: E402
from bazaarscope.plans import quality_counts, quarantine, reconcile, refresh, register, sellers, star_checks  # noqa: E402
from bazaarscope.session import scratch_path, tune  # noqa: E402
from bazaarscope.sources import bindings, raw_csv, sink, versions  # noqa: E402
from bazaarscope.sources.bindings import PERIODS, SHIPPING_LIMIT_FROM  # noqa: E402
from bazaarscope.sources.model import SCHEMAS, Marketplace  # noqa: E402
from oracles import measure_checks as expected_measures, quality, reports, star  # noqa: E402

try:  # the corpus operators and their pipeline are one removable part
    import corpus_pipeline
    from bazaarscope.llm import registry as corpus
except ModuleNotFoundError as absent:
    if absent.name not in ("corpus_pipeline", "bazaarscope.llm"):
        raise  # an operator that cannot be imported is a fault, not a missing part
    corpus_pipeline = corpus = None

Query = Callable[[SparkSession, str], DataFrame]


def _iso(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, so that both engines hash the same values."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        value = F.col(field.name)
        if kind == "date":
            value = F.date_format(value, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif kind == "decimal":
            value = value.cast("double")
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _on_clean(plan, *args) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _iso(plan(bindings.bind(tune(spark), sf_dir), *args))

    return run


def _reports() -> dict[str, Query]:
    return {
        "marketplace_scale": _on_clean(marketplace.scale),
        "monthly_trends": _on_clean(marketplace.monthly_trends, PERIODS),
        "matched_period_metrics": _on_clean(marketplace.matched_period_metrics, PERIODS),
        "matched_period_growth": _on_clean(marketplace.matched_period_growth, PERIODS),
        "status_mix": _on_clean(marketplace.status_mix, PERIODS),
        "merchandise_by_status": _on_clean(marketplace.merchandise_by_status),
        "marketplace_concentration": _on_clean(marketplace.concentration),
        "customer_base_repeat": _on_clean(customers.base_and_repeat),
        "customer_order_frequency": _on_clean(customers.order_frequency),
        "customer_one_time_vs_repeat": _on_clean(customers.one_time_vs_repeat),
        "customer_value_deciles": _on_clean(customers.value_deciles),
        "customer_geography": _on_clean(customers.geography),
        "delivery_population": _on_clean(delivery.population),
        "delivery_chronology": _on_clean(delivery.chronology),
        "delivery_reliability": _on_clean(delivery.reliability),
        "delivery_percentiles": _on_clean(delivery.percentiles),
        "delivery_by_month": _on_clean(delivery.by_month, PERIODS),
        "delivery_by_matched_year": _on_clean(delivery.by_matched_year, PERIODS),
        "delivery_review_coverage": _on_clean(delivery.review_coverage),
        "delay_review_outcomes": _on_clean(delivery.delay_and_reviews),
        "delivery_by_state": _on_clean(delivery.by_state),
        "category_population": _on_clean(categories.population),
        "category_performance": _on_clean(categories.performance),
        "category_growth": _on_clean(categories.growth, PERIODS),
        "product_concentration": _on_clean(categories.product_concentration),
        "top_products": _on_clean(categories.top_products),
        "category_review_outcomes": _on_clean(categories.review_outcomes),
        "seller_population": _on_clean(sellers.population),
        "top_sellers": _on_clean(sellers.top_sellers),
        "seller_base_growth": _on_clean(sellers.base_growth, PERIODS),
        "seller_participation": _on_clean(sellers.participation, PERIODS),
        "seller_geography": _on_clean(sellers.geography),
        "payment_population": _on_clean(payments.population),
        "payment_method_mix": _on_clean(payments.method_mix),
        "payment_method_combinations": _on_clean(payments.method_combinations),
        "installment_distribution": _on_clean(payments.installment_distribution),
        "installment_bands": _on_clean(payments.installment_bands),
        "payments_by_month_and_method": _on_clean(payments.by_month_and_method, PERIODS),
        "metric_reconciliation": _on_clean(reconcile.reconciliation, reconcile.PUBLISHED),
    }


def _on_raw(plan, *args) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _iso(plan(bindings.bind_raw(tune(spark), sf_dir), *args))

    return run


def _on_both(plan, *args) -> Query:
    """Plans over the raw tables and what cleaning makes of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = bindings.bind_raw(tune(spark), sf_dir)
        return _iso(plan(raw, cleaning.clean(raw), *args))

    return run


def _on_star(plan, *args) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _iso(plan(facts.Star.of(bindings.bind(tune(spark), sf_dir), PERIODS), *args))

    return run


def _star() -> dict[str, Query]:
    return {
        "fact_orders": _on_clean(facts.fact_orders),
        "fact_order_categories": _on_clean(facts.fact_order_categories),
        "fact_seller_orders": _on_clean(facts.fact_seller_orders),
        "fact_payments": _on_clean(facts.fact_payments),
        "dim_date": _on_clean(facts.dim_date, PERIODS),
        "dim_category": _on_clean(facts.dim_category),
        "dim_seller": _on_clean(facts.dim_seller),
        "dim_customer_state": _on_clean(facts.dim_customer_state),
        "star_grain_checks": _on_star(star_checks.grain_checks),
        "star_link_checks": _on_star(star_checks.link_checks),
        "fact_refresh": _refreshed,
        "star_integrity": _on_star(star_checks.integrity),
        "star_calendar_check": _on_star(star_checks.calendar_check),
        "star_cross_fact_check": _on_star(star_checks.cross_fact_check),
        "star_fact_reconciliation": _on_star(star_checks.fact_reconciliation),
    }


def _rounded(df: DataFrame) -> DataFrame:
    """Money to two and ratios to four digits."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        value = F.col(field.name)
        if kind == "decimal":
            value = rounded(value)
        elif kind == "double":
            value = rounded(value, 4)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _measured(fact: str, names: list[str], by: tuple[str, ...] = (), context=None) -> Query:
    """Measures by group; ``context`` yields keyword filters once a session exists."""

    def plan(s: facts.Star) -> DataFrame:
        return _rounded(measures.evaluate(s, names, by, **(context() if context else {})))

    assert all(measures.MEASURES[n].fact == fact for n in names)
    return _on_star(plan)


def _names(fact: str) -> list[str]:
    return [n for n, m in measures.MEASURES.items() if m.fact == fact]


def _purchased(window):
    return window.contains(F.col("order_purchase_date").cast("timestamp_ntz"))


def _seller_measures(s: facts.Star) -> DataFrame:
    states = F.col("seller_state").isin("NATION_3", "NATION_7", "NATION_15", "NATION_20")
    rows = measures.sliced(
        s["fact_seller_orders"], "seller_id", s["dim_seller"], "seller_id", states
    )
    star_slice = facts.Star({"fact_seller_orders": rows})
    return _rounded(measures.evaluate(star_slice, _names("fact_seller_orders")))


def _in_context(fact: str, names: list[str], by: tuple[str, ...], **conditions: str) -> Query:
    """Measures under filters on dimension members."""
    return _measured(fact, names, by, lambda: {
        "dimensions": {name: F.expr(text) for name, text in conditions.items()}
    })


def _measures() -> dict[str, Query]:
    orders = _names("fact_orders")
    by_method = {
        "orders_using_payment_method", "payment_value_by_method",
        "payment_method_order_usage_rate", "payment_value_share",
    }
    categories_chosen = ["ECONOMY", "SMALL", "__unknown__"]
    first_year = PERIODS.matched[0][1]
    return {
        "measures_marketplace": _measured("fact_orders", orders[:8], ("customer_state",)),
        "measures_customers": _measured(
            "persons", _names("persons"), ("customer_state",),
            lambda: {"where": _purchased(first_year)},
        ),
        "measures_delivery_reviews": _measured("fact_orders", orders[8:], ("delay_band",)),
        "measures_categories": _measured(
            "fact_order_categories", _names("fact_order_categories"),
            ("category_key", "category_display_name"),
            lambda: {
                "where": _purchased(PERIODS.core),
                "only": F.col("category_key").isin(categories_chosen),
            },
        ),
        "measures_sellers": _on_star(_seller_measures),
        "measures_customers_all": _measured("persons", _names("persons"), ("customer_state",)),
        "measures_categories_all": _measured(
            "fact_order_categories", _names("fact_order_categories"),
            ("category_key", "category_display_name"),
        ),
        "measures_sellers_all": _measured("fact_seller_orders", _names("fact_seller_orders")),
        "measures_payment_methods_all": _measured(
            "fact_payments", [n for n in _names("fact_payments") if n in by_method],
            ("payment_type",),
        ),
        # the delivery and review measures under the filters the order measures have below
        "measures_reviews_in_month": _in_context(
            "fact_orders", orders[8:], ("customer_state",),
            dim_date="date >= '1996-03-01' AND date < '1996-04-01'",
        ),
        "measures_reviews_in_year": _in_context(
            "fact_orders", orders[8:], ("customer_state",),
            dim_date="date >= '1996-01-01' AND date < '1997-01-01'",
        ),
        "measures_reviews_in_state": _in_context(
            "fact_orders", orders[8:], ("customer_state",),
            dim_customer_state="state_code IN ('NATION_3', 'NATION_7')",
        ),
        "measures_reviews_isolated": _in_context(
            "fact_orders", orders[8:], ("customer_state",),
            dim_seller="seller_state = 'NATION_3'", dim_category="category_key = 'ECONOMY'",
        ),
        "measures_in_month": _in_context(
            "fact_orders", orders[:8], ("customer_state",),
            dim_date="date >= '1996-03-01' AND date < '1996-04-01'",
        ),
        "measures_in_year": _in_context(
            "fact_orders", orders[:8], ("customer_state",),
            dim_date="date >= '1996-01-01' AND date < '1997-01-01'",
        ),
        "measures_in_state": _in_context(
            "fact_orders", orders[:8], ("customer_state",),
            dim_customer_state="state_code IN ('NATION_3', 'NATION_7')",
        ),
        "measures_in_category": _in_context(
            "fact_order_categories", _names("fact_order_categories"),
            ("category_key", "category_display_name"), dim_category="category_key = 'ECONOMY'",
            dim_date="date >= '1996-01-01' AND date < '1997-09-01'",
        ),
        "measures_in_seller_state": _in_context(
            "fact_seller_orders", _names("fact_seller_orders"), (),
            dim_seller="seller_state IN ('NATION_3', 'NATION_7', 'NATION_15', 'NATION_20')",
        ),
        # sellers and categories are not linked to the order fact
        "measures_isolated": _in_context(
            "fact_orders", orders[:8], ("customer_state",),
            dim_seller="seller_state = 'NATION_3'", dim_category="category_key = 'ECONOMY'",
        ),
        "measures_payments": _measured(
            "fact_payments", [n for n in _names("fact_payments") if n not in by_method]
        ),
        "measures_payment_methods": _measured(
            "fact_payments", [n for n in _names("fact_payments") if n in by_method],
            ("payment_type",), lambda: {"only": F.col("payment_type") != "voucher"},
        ),
        "measures_matched": _on_star(
            lambda s: _rounded(measures.matched(
                s, ["completed_orders", "completed_item_sales_value"], PERIODS))
        ),
        "measures_matched_customers": _on_star(
            measures.matched,
            ["completed_unique_customers", "observed_repeat_customers"], PERIODS,
        ),
        "measures_category_matched": _on_star(measures.category_matched, PERIODS),
        "measure_reconciliation": _measure_reconciliation,
    }


def _measure_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish the star, so that every fact is built once, and hold its measures against the reports."""
    mk = bindings.bind(tune(spark), sf_dir)
    folder = scratch_path(spark, "star")
    facts.Star.of(mk, PERIODS).publish(folder)
    return measure_checks.reconciliation(mk, facts.Star.read(spark, folder), PERIODS)


LATE_FROM = "1998-01-01"


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the star without the orders of the last year, refresh it with them; every fact by month,
    with the load its rows come from."""
    mk = bindings.bind(tune(spark), sf_dir)
    folder = scratch_path(spark, "star")
    late = F.col(facts.PURCHASE) >= F.lit(LATE_FROM).cast("timestamp_ntz")
    before = mk.replaced(orders=mk.orders.where(~late))
    refresh.refresh(None, before, PERIODS, spark, folder, "first")
    manifest = refresh.refresh(before, mk, PERIODS, spark, folder, "late")
    star, parts = refresh.read(spark, folder), []
    for name in refresh.FACTS:
        month = F.date_format("order_purchase_date", "yyyy-MM").alias("purchase_month")
        source = {m: path.split("/")[1] for m, path in manifest["months"][name].items()}
        loads = F.create_map(*[F.lit(x) for pair in source.items() for x in pair])
        rows = star[name].groupBy(month).agg(F.count("*").alias("rows"))
        parts.append(rows.select(F.lit(name).alias("fact"), "*", loads[F.col("purchase_month")].alias("load")))
    return union_all(parts)


# folders of counts made in this application, by folder and state of the files they were made of
_STORED_COUNTS: dict[tuple, str] = {}


def _from_counts(plan) -> Query:
    """Reports on the table of quality counts, which is stored once for all of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = bindings.bind_raw(tune(spark), sf_dir)
        cleaned = cleaning.clean(raw)
        key = (spark.sparkContext.applicationId, sf_dir, bindings.fingerprint(spark, sf_dir))
        if key not in _STORED_COUNTS:
            _STORED_COUNTS[key] = scratch_path(spark, "quality")
            found = quality_counts.tallied(raw, cleaned, SHIPPING_LIMIT_FROM)
            quality_counts.store(found, _STORED_COUNTS[key])
        return plan(quality_counts.read(spark, _STORED_COUNTS[key]), raw, cleaned)

    return run


def _register(counts: DataFrame, raw: Marketplace, cleaned: Marketplace) -> DataFrame:
    return register.register_of(counts, raw, cleaned, SHIPPING_LIMIT_FROM)


def _cleaned(table: str) -> Query:
    return _on_raw(lambda raw: cleaning.clean_table(raw, table))


def _id_summary(mk: Marketplace) -> DataFrame:
    return versions.with_stable_ids(mk.geolocation, None, 0).agg(
        F.count("*").alias("rows"),
        F.count_distinct("geolocation_id").alias("distinct_ids"),
        F.min("geolocation_id").alias("first_id"),
        F.max("geolocation_id").alias("last_id"),
    )


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, write as Parquet in load order, read back and count."""
    cleaned = cleaning.clean(bindings.bind_raw(tune(spark), sf_dir))
    return sink.load(cleaned, spark, scratch_path(spark, "load"))


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the raw tables as CSV, ingest the files, clean them and count against Parquet."""
    raw = bindings.bind_raw(tune(spark), sf_dir)
    folder = scratch_path(spark, "csv")
    raw_csv.write_raw(raw, folder)
    ingested = cleaning.clean(raw_csv.read_raw(spark, folder))
    return sink.load_counts(cleaning.clean(raw), ingested)


def _quality() -> dict[str, Query]:
    return {
        **{f"clean_{table}": _cleaned(table) for table in SCHEMAS},
        "cleaning_changes": _on_raw(cleaning.change_summary),
        "cleaning_conversion_audit": _on_raw(cleaning.violations),
        "cleaning_row_counts": _on_both(cleaning.row_counts),
        "cleaning_duplicate_removal": _on_raw(cleaning.duplicate_removal),
        "cleaning_retained_values": _on_clean(cleaning.retained_values, SHIPPING_LIMIT_FROM),
        "cleaning_assertions": _on_both(cleaning.assertions),
        "audit_inventory": _on_clean(audit.inventory),
        "audit_structure": _on_clean(audit.structure),
        "audit_keys": _on_clean(audit.key_checks),
        "audit_duplicates": _on_clean(audit.duplicates),
        "audit_duplicates_raw": _on_raw(audit.duplicates),
        "audit_repeated_ids": _on_clean(audit.repeated_ids),
        "audit_orphans": _on_clean(audit.relationship_orphans),
        "audit_parent_coverage": _on_clean(audit.parent_coverage),
        "audit_cardinality": _on_clean(audit.cardinality),
        "audit_missing_values": _on_clean(audit.missing_values),
        "audit_missing_by_table": _on_clean(audit.missing_by_table),
        "audit_distributions": _on_clean(audit.distributions),
        "audit_domain_violations_raw": _on_raw(audit.domain_violations),
        "audit_state_codes": _on_clean(audit.state_codes),
        "audit_numeric_profile": _on_clean(audit.numeric_profile),
        "audit_outliers": _on_clean(audit.outliers),
        "audit_numeric_rules": _on_clean(audit.numeric_rule_checks),
        "audit_domain_rules": _on_clean(audit.domain_rule_checks),
        "audit_date_ranges": _on_clean(audit.date_ranges),
        "audit_order_timeline": _on_clean(audit.order_timeline),
        "audit_shipping_limits": _on_clean(audit.shipping_limits, SHIPPING_LIMIT_FROM),
        "audit_review_timeline": _on_clean(audit.review_timeline),
        "audit_text_fields": _on_raw(audit.text_fields),
        "audit_numeric_city_names": _on_clean(audit.numeric_city_names),
        "audit_lookup_coverage": _on_clean(audit.lookup_coverage),
        "audit_untranslated_categories": _on_clean(audit.untranslated_categories),
        "audit_zip_coverage": _on_clean(audit.zip_coverage),
        "audit_geolocation_density": _on_clean(audit.geolocation_density),
        "audit_findings": _from_counts(
            lambda counts, raw, _: register.findings_of(counts, raw, SHIPPING_LIMIT_FROM)
        ),
        "geolocation_surrogate_ids": _on_clean(_id_summary),
        "join_grain_reference": _on_clean(register.join_grains),
        "validation_register": _from_counts(_register),
        "validation_summary": _from_counts(lambda *parts: register.summary(_register(*parts))),
        "validation_readiness": _from_counts(lambda *parts: register.readiness(_register(*parts))),
        "quarantine_rows": _on_raw(
            quarantine.report, ("orders", "order_items", "payments", "products"), SHIPPING_LIMIT_FROM
        ),
        "load_parquet_counts": _loaded,
        "load_csv_roundtrip_counts": _csv_roundtrip,
    }


LOAD_SECTIONS = {
    "rows": load_checks.row_counts,
    "keys": load_checks.keys,
    "foreign_keys": load_checks.foreign_keys,
    "coverage": load_checks.coverage,
    "cardinality": load_checks.cardinality,
    "nulls": load_checks.nulls,
    "numeric_ranges": load_checks.numeric_ranges,
    "unusual_values": load_checks.unusual_values,
    "temporal_anomalies": lambda mk: load_checks.temporal_anomalies(mk, SHIPPING_LIMIT_FROM),
    "categories": load_checks.categories,
}


def _loaded_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all tables as a version and look at the ids that were stored."""
    cleaned = cleaning.clean(bindings.bind_raw(tune(spark), sf_dir))
    folder = scratch_path(spark, "versions")
    versions.load(cleaned, spark, folder, "first")
    mk = versions.read(spark, folder)
    found = load_checks.geolocation(mk.replaced(geolocation=mk.geolocation.drop(versions.GEO_ID)), mk.geolocation)
    return _iso(load_checks.judged(found, load_checks.PUBLISHED["geolocation"]))


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, load again, and append all but the reviews below five: rows of each table by version."""
    cleaned = cleaning.clean(bindings.bind_raw(tune(spark), sf_dir))
    folder = scratch_path(spark, "versions")
    versions.load(cleaned, spark, folder, "first")
    versions.load(cleaned, spark, folder, "again")
    versions.load(cleaned.replaced(reviews=cleaned.reviews.where("review_score = 5")), spark, folder, "more", append=True)
    parts = []
    for version in (1, versions.current(spark, folder)["version"]):
        counts = audit.inventory(versions.read(spark, folder, version)).select("table_name", "rows")
        parts.append(counts.withColumn("version", F.lit(version)))
    return parts[0].unionByName(parts[1])


def _load_section(name: str) -> Query:
    expected = load_checks.PUBLISHED.get(name)
    return _on_clean(lambda mk: load_checks.judged(LOAD_SECTIONS[name](mk), expected))


def _corpus() -> dict[str, Query]:
    return {**corpus.queries(), "pipeline": corpus_pipeline.run} if corpus else {}


def entry(spark: SparkSession) -> DataFrame:
    """Monthly marketplace trends on the smallest test tables."""
    return queries()["monthly_trends"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """Every registered query by name."""
    return {
        **_reports(),
        **_star(),
        **_measures(),
        **_quality(),
        **{f"load_check_{name}": _load_section(name) for name in LOAD_SECTIONS},
        "load_check_geolocation": _loaded_geolocation,
        "load_versions": _versioned,
        **_corpus(),
    }


def oracle_sql() -> dict[str, str]:
    """The DuckDB query that must give the same rows, for each registered query."""
    return {
        **reports.SQL,
        "metric_reconciliation": reports.reconciliation(reconcile.PUBLISHED),
        **star.SQL,
        "measure_reconciliation": expected_measures.RECONCILIATION,
        "star_fact_reconciliation": star.fact_reconciliation(star_checks.PUBLISHED_TOTALS),
        **quality.SQL,
        **{
            f"load_check_{name}": quality.load_section(name, load_checks.PUBLISHED.get(name))
            for name in (*LOAD_SECTIONS, "geolocation")
        },
        **(corpus.oracle_sql() if corpus else {}),
        **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus and corpus_pipeline.ORACLE_SQL else {}),
    }
