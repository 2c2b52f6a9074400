"""Several distinct counts per group from one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_member(
    rows: DataFrame, by: Sequence[str], members: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Aggregates per group and member, for each member column in turn.

    One grouping set per member column, so a row is expanded once per column and meets
    its equals on the map side. ``_member`` names the column a result row belongs to.
    """
    sets = [[*by, m] for m in members]
    which = F.lit(None).cast("string")
    for m in reversed(members):
        which = F.when(F.grouping(m) == 0, m).otherwise(which)
    return rows.groupingSets(sets, *by, *members).agg(
        which.alias("_member"), *[expr.alias(name) for name, expr in sums.items()]
    )


def member_counts(
    rows: DataFrame,
    by: Sequence[str],
    members: Mapping[str, str],
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Distinct counts of several columns per group, beside additive sums.

    ``members`` maps output names to columns. ``count_distinct`` on several columns would
    expand every row once more than this and carry the sums through all copies.
    """
    sums = sums or {}
    columns = list(members.values())
    detailed = per_member(rows, by, columns, sums)
    first = F.col("_member") == columns[0]
    return detailed.groupBy(*by).agg(
        *[
            F.count_if((F.col("_member") == column) & F.col(column).isNotNull()).alias(name)
            for name, column in members.items()
        ],
        *[F.sum(F.when(first, F.col(name))).alias(name) for name in sums],
    )
