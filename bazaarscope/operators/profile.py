"""Profiles of many columns in one aggregate, returned one row per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarscope.operators.tally import digest

c = F.col


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def long_aggregate(
    rows: DataFrame, entries: Sequence[tuple[Mapping[str, Column], Mapping[str, Column]]]
) -> DataFrame:
    """One aggregate over ``rows``, one output row per entry.

    An entry is (constants, aggregates): named literals that identify the row, and named
    aggregate expressions. All entries have the same names.
    """
    wide, structs = [], []
    for i, (constants, aggregates) in enumerate(entries):
        fields = [value.alias(name) for name, value in constants.items()]
        for name, value in aggregates.items():
            wide.append(value.alias(f"_{i}_{name}"))
            fields.append(c(f"_{i}_{name}").alias(name))
        structs.append(F.struct(*fields))
    return rows.agg(*wide).select(F.inline(F.array(*structs)))


def values_long(
    rows: DataFrame, columns: Sequence[str], kind: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Unpivot: column_name and value, one row per cell of the chosen columns."""
    cells = [
        F.struct(F.lit(name).alias("column_name"), c(name).cast(kind).alias("value"))
        for name in columns
    ]
    return rows.select(*keep, F.inline(F.array(*cells)))


def distinct_counts(rows: DataFrame) -> DataFrame:
    """column_name, non_null_count, null_count, unique_values of every column, exactly.

    Equal values of a column meet on the map side first, so frequent values cost nothing. Cells
    travel as digests of 128 bits, however long they are: two of n values are taken for one
    with probability n^2 / 2^129.
    """
    names = rows.columns
    cells = [
        F.struct(F.lit(i).alias("i"), c(name).isNotNull().alias("present"), *aliased_digest([c(name)])[:2])
        for i, name in enumerate(names)
    ]
    per_value = rows.select(F.inline(F.array(*cells))).groupBy("i", "present", "a", "b").agg(F.count("*").alias("n"))
    column = F.element_at(F.array(*map(F.lit, names)), c("i") + 1).alias("column_name")
    return per_value.groupBy("i").agg(
        F.coalesce(F.sum(F.when(c("present"), c("n"))), F.lit(0)).alias("non_null_count"),
        F.coalesce(F.sum(F.when(~c("present"), c("n"))), F.lit(0)).alias("null_count"),
        F.count_if("present").alias("unique_values"),
    ).select(column, "non_null_count", "null_count", "unique_values")


def aliased_digest(columns: Sequence[Column]) -> list[Column]:
    """128 bits of some cells, and 64 further ones that tell a collision of them."""
    first, second = digest(columns)
    return [first.alias("a"), second.alias("b"), F.xxhash64(F.lit(3), *columns).alias("check")]


def collision_bounds() -> list[Column]:
    return [F.min("check").alias("low"), F.max("check").alias("high")]


def when_one_value(n: Column) -> Column:
    """``n`` of a group of equal digests; different values behind one digest stop the job."""
    collided = F.raise_error(F.lit("two values share a digest")).cast("bigint")
    return F.when(c("low") == c("high"), n).otherwise(collided)
