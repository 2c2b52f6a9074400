"""Rows that break rules, split off while cleaning with the address they came from.

Every raw row is converted once and carries the set of rules it breaks: cells that do not convert,
required cells that are missing, and whatever rules are watched (numbers, timeline, shipping
limits). Rows without a broken rule are the clean table; the others keep their raw cells, their
file and their place in it, can be counted per rule, mended and replayed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarscope.functions import domain as D
from bazaarscope.operators.profile import union_all
from bazaarscope.operators.tally import Rule, bits, labels_of
from bazaarscope.plans import audit as A
from bazaarscope.plans import cleaning as C
from bazaarscope.plans import quality_counts as Q
from bazaarscope.sources.model import SCHEMAS, Marketplace

c = F.col


@dataclass
class Split:
    """Rows of one table: ``clean`` as cleaning gives them, ``broken`` with address and rules."""

    clean: DataFrame
    broken: DataFrame


def watched(table: str, shipping_limit_from: str | None = None) -> list[Rule]:
    """Rules on the values of a row that the audit looks at."""
    rules = list(A.domain_rules().get(table, []))
    rules += [r for r in A.audit_rules().get(table, []) if r[0] not in dict(rules)]
    rules += A.order_timeline_rules() if table == "orders" else []
    if table == "order_items" and shipping_limit_from:
        rules.append(A.shipping_rules(shipping_limit_from)[1])
    return rules


def _conversion_rules(table: str) -> list[Rule]:
    rules: list[Rule] = []
    optional = D.NULLABLE_COLUMNS.get(table, ())
    for f in SCHEMAS[table].fields:
        cell = c("cells")[f.name]
        if C._may_fail(table, f):
            rules.append((Q.failed_rule(f.name), cell.isNotNull() & c(f.name).isNull()))
        if f.name not in optional:
            missing = cell.isNull() if C._may_fail(table, f) else c(f.name).isNull()
            rules.append((Q.null_rule(f.name), missing))
    return rules


def rules_of(table: str, watch: Sequence[Rule] = ()) -> list[str]:
    """The labels of all rules of a table, in the order of their bits."""
    return labels_of([*_conversion_rules(table), *watch])


def _typed(table: str, rows: DataFrame, watch: Sequence[Rule]) -> DataFrame:
    """``file, row, cells`` (raw text under the declared names) -> with typed columns and rules."""
    names = [f.name for f in SCHEMAS[table].fields]
    flat = rows.select("file", "row", "cells", "cells.*")
    typed = flat.select("file", "row", "cells", *(C._parsed(table, f).alias(f.name) for f in SCHEMAS[table].fields))
    met = typed.select("file", "row", "cells", *names, bits([*_conversion_rules(table), *watch]).alias("met"))
    # a filter on a generated column stays above it; pushed below the conversions, it would
    # convert every cell again for each rule that looks at it
    return met.select("file", "row", "cells", *names, F.explode(F.array("met")).alias("broken"))


def _addressed(raw: Marketplace, table: str, row_index: bool) -> DataFrame:
    """Raw rows with their file and their place in it.

    Formats without a row index, such as CSV, give the start of the split and a digest of the cells.
    """
    rows = C._renamed(raw, table)
    names = [f.name for f in SCHEMAS[table].fields]
    cells = F.struct(*(c(n) for n in names))
    if row_index:
        row = c("_metadata.row_index").cast("string")
    else:
        row = F.concat_ws("-", c("_metadata.file_block_start"), F.md5(F.to_json(cells).cast("binary")))
    return rows.select(c("_metadata.file_path").alias("file"), row.alias("row"), cells.alias("cells"))


def marked(raw: Marketplace, table: str, watch: Sequence[Rule] = (), row_index: bool = True) -> DataFrame:
    """All rows of a table with address, raw cells, typed columns and the set of broken rules."""
    return _typed(table, _addressed(raw, table, row_index), watch)


def _labels(table: str, watch: Sequence[Rule]) -> Column:
    labels = F.array(*map(F.lit, rules_of(table, watch)))
    met = F.transform(labels, lambda label, i: F.when(F.call_function("bit_get", c("broken"), i) == 1, label))
    return F.filter(met, lambda label: label.isNotNull())


def _split(table: str, rows: DataFrame, watch: Sequence[Rule]) -> Split:
    names = [f.name for f in SCHEMAS[table].fields]
    clean = rows.where("broken = 0").select(*names)
    clean = clean.dropDuplicates() if table == "geolocation" else clean
    broken = rows.where("broken <> 0").select(
        F.lit(table).alias("table_name"), "file", "row", "cells", _labels(table, watch).alias("rules")
    )
    return Split(clean, broken)


def split(raw: Marketplace, table: str, watch: Sequence[Rule] = (), row_index: bool = True) -> Split:
    return _split(table, marked(raw, table, watch, row_index), watch)


def write_split(
    raw: Marketplace, table: str, folder: str, watch: Sequence[Rule] = (), row_index: bool = True
) -> Split:
    """Convert a table once and write both parts: ``kept=true`` and ``kept=false`` of one folder."""
    rows = marked(raw, table, watch, row_index).withColumn("kept", c("broken") == 0)
    rows.write.partitionBy("kept").mode("errorifexists").parquet(folder)
    spark = rows.sparkSession
    stored = spark.read.schema(rows.schema).parquet(folder)
    clean = stored.where("kept")
    return Split(_split(table, clean, watch).clean, _split(table, stored.where("NOT kept"), watch).broken)


def rule_counts(broken: Sequence[DataFrame]) -> DataFrame:
    """``table_name, rule, rows`` of the rows split off."""
    rows = union_all([b.select("table_name", F.explode("rules").alias("rule")) for b in broken])
    return rows.groupBy("table_name", "rule").agg(F.count("*").alias("rows"))


FIXES = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("row", T.StringType()),
    T.StructField("column_name", T.StringType()), T.StructField("value", T.StringType()),
])


def replay(table: str, broken: DataFrame, fixes: DataFrame, watch: Sequence[Rule] = ()) -> Split:
    """Rows with mended cells, judged anew. ``fixes`` has ``FIXES``; of two fixes of one cell the
    greater text counts, and rows without a fix stay where they are.

    ``clean`` holds the rows that pass now, to be appended; ``broken`` all that still do not.
    """
    names = [f.name for f in SCHEMAS[table].fields]
    new = fixes.groupBy("file", "row", "column_name").agg(F.max("value").alias("value")).groupBy("file", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "value"))).alias("new")
    )
    rows = broken.join(new, ["file", "row"], "left")
    mended = F.struct(*(
        F.when(F.map_contains_key("new", n), F.get(F.array(F.try_element_at("new", F.lit(n))), 0))
        .otherwise(c("cells")[n]).alias(n)
        for n in names
    ))
    return _split(table, _typed(table, rows.select("file", "row", mended.alias("cells")), watch), watch)


def report(raw: Marketplace, tables: Sequence[str], shipping_limit_from: str) -> DataFrame:
    """``table_name, source_row, rules`` of every row of the tables that would be split off."""
    parts = [split(raw, t, watched(t, shipping_limit_from)).broken for t in tables]
    return union_all([
        p.select("table_name", c("row").cast("bigint").alias("source_row"), F.array_join("rules", "; ").alias("rules"))
        for p in parts
    ])
