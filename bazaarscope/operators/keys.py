"""Operators on keys: latest row, referential checks, group sizes, surrogate ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarscope.operators.profile import aliased_digest, collision_bounds, when_one_value

_ID_BUCKETS = 4096


def latest_per_key(
    rows: DataFrame, key: str, order: Sequence[str], take: Sequence[str]
) -> DataFrame:
    """Columns ``take`` of the row with the greatest ``order`` per key.

    A maximum over a struct combines on the map side, so a key that owns a large part of
    the rows is reduced before the shuffle; a row_number window would sort it in one task.
    """
    best = F.max(F.struct(*order, *take)).alias("_best")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in take])


def key_profile(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: total, distinct combinations and rows with a NULL in the key."""
    incomplete = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("unique_combinations"),
        F.coalesce(F.sum(F.when(incomplete, F.col("n"))), F.lit(0)).alias("missing_key_rows"),
    )


def orphan_rows(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: child rows whose key is set but has no parent.

    The child is counted per key first, so the join sees each key once.
    """
    counted = (
        child.filter(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("_key"))
        .agg(F.count("*").alias("n"))
    )
    known = parent.select(F.col(parent_key).alias("_key"))
    return counted.join(known, "_key", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows")
    )


def childless_rows(
    parent: DataFrame, parent_key: str, child: DataFrame, child_key: str
) -> DataFrame:
    """One row: parent rows without a child."""
    used = child.select(F.col(child_key).alias("_key")).distinct()
    rows = parent.select(F.col(parent_key).alias("_key"))
    return rows.join(used, "_key", "left_anti").agg(F.count("*").alias("childless_rows"))


def duplicate_profile(rows: DataFrame) -> DataFrame:
    """One row: totals of groups of fully identical rows, which travel as digests."""
    digests = rows.select(*aliased_digest([F.col(name) for name in rows.columns]))
    per_row = digests.groupBy("a", "b").agg(F.count("*").alias("n"), *collision_bounds())
    n = when_one_value(F.col("n"))
    return per_row.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_in_duplicate_groups"),
        F.count_if(n > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("excess_duplicate_rows"),
    )


def dense_ids(rows: DataFrame, name: str, buckets: int = _ID_BUCKETS) -> DataFrame:
    """Number distinct rows 1..n in parallel; the same rows always get the same ids.

    Rows are dealt to hash buckets, numbered inside a bucket by their columns, and shifted
    by the sizes of the earlier buckets. Only the bucket sizes are ranked together.
    """
    columns = rows.columns
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy(*columns)
    return dealt.join(offsets, "_bucket").select(
        (F.col("_offset") + F.row_number().over(inside)).cast("bigint").alias(name), *columns
    )

