"""Leading rows of a large grouped result together with a total over all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_with_total(rows: DataFrame, order: Sequence[Column], k: int, total: str) -> DataFrame:
    """The first ``k`` rows, with ``rank`` and the sum of ``total`` over every row.

    Every task keeps its own ``k`` leading rows, however many tasks there are; the sum is a
    scalar over the same grouped rows. ``order`` must be total.
    """
    everything = rows.agg(F.sum(total).alias("t")).scalar()
    leading = rows.orderBy(*order).limit(k)
    ranked = Window.orderBy(*order)  # over k rows
    return leading.withColumn("rank", F.row_number().over(ranked)).withColumn(
        "grand_total", everything
    )
