"""Exact order statistics without a global sort.

A ranking over all customers or products, written as a window without partition keys,
pulls every row into one task. Here the rows are first collapsed to a histogram of the
distinct values, which is an ordinary aggregate with map-side combine, and each value is
put in a coarse bucket, and in that in a fine one, by a fixed function of the value. There are
at most 2**15 coarse buckets however large the data and 2**9 fine ones in each, so their running
totals are small; inside a fine bucket the running totals are computed in parallel. Rows that tie on the value need no order among
themselves: ranks inside a histogram row are arithmetic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Leading bits of the value that pick its coarse bucket, at most 64 * 2**8 per sign, and as many
# following ones that pick the fine bucket: values in a narrow range still spread.
_BITS = 9


def order_bucket(key: Column) -> Column:
    """Bucket of a bigint that never decreases when the key grows."""

    def magnitude(v: Column) -> Column:
        width = F.length(F.bin(v))
        shift = F.greatest(width - _BITS, F.lit(0))
        return width * (1 << _BITS) + F.call_function("shiftright", v, shift)

    bucket = F.when(key >= 0, magnitude(key)).otherwise(-magnitude(-key)).cast("int")
    # never NULL, so a join on it adds no filter that would keep plans from sharing a shuffle
    return F.coalesce(bucket, F.lit(0))


def fine_bucket(key: Column) -> Column:
    """Bucket inside ``order_bucket`` that never decreases there when the key grows."""

    def magnitude(v: Column) -> Column:
        shift = F.greatest(F.length(F.bin(v)) - 2 * _BITS, F.lit(0))
        return F.call_function("shiftright", v, shift).bitwiseAND(F.lit((1 << _BITS) - 1))

    bucket = F.when(key >= 0, magnitude(key)).otherwise(-magnitude(-key)).cast("int")
    return F.coalesce(bucket, F.lit(0))


def decimal_key(value: Column) -> Column:
    """A bigint that never decreases with a double: ten decimals, clamped at the ends."""
    scaled = F.least(F.greatest(F.floor(value * 1e10), F.lit(-9e18)), F.lit(9e18))
    return scaled.cast("bigint")


def histogram(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with its number of rows ``n``."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def running_totals(
    hist: DataFrame,
    value: str,
    key: Column,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``<name>_before`` and ``<name>_total`` for every entry of ``sums``.

    ``hist`` has one row per (by, value); ``key`` is a bigint that never decreases with
    ``value``. ``by`` must be columns with few distinct values.
    """
    by = list(by)
    bucket, fine = order_bucket(key), fine_bucket(key)
    direction = F.col(value).desc() if descending else F.col(value).asc()
    rows = hist.select(
        *hist.columns,
        *[expr.alias(f"_{name}") for name, expr in sums.items()],
        (-bucket if descending else bucket).alias("_bucket"),
        (-fine if descending else fine).alias("_fine"),
    )
    split = [*by, "_bucket", "_fine"]
    small = rows.groupBy(*split).agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in sums])
    coarse = small.groupBy(*by, "_bucket").agg(
        *[F.sum(f"_{name}").alias(f"_{name}") for name in sums]
    )
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_off") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    finer = (
        Window.partitionBy(*by, "_bucket")
        .orderBy("_fine")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = small.join(offsets, [*by, "_bucket"]).select(
        *split,
        *[
            (F.col(f"_{n}_off") + F.coalesce(F.sum(f"_{n}").over(finer), F.lit(0))).alias(
                f"_{n}_off"
            )
            for n in sums
        ],
        *[f"{n}_total" for n in sums],
    )
    inside = (
        Window.partitionBy(*split)
        .orderBy(direction)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = rows.join(offsets, split)
    return joined.select(
        *hist.columns,
        *[
            (F.col(f"_{n}_off") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0))).alias(
                f"{n}_before"
            )
            for n in sums
        ],
        *[f"{n}_total" for n in sums],
    )


def quantiles(
    hist: DataFrame,
    value: str,
    key: Column,
    linear: Mapping[str, int] | None = None,
    nearest: Mapping[str, int] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles of a histogram, one row per ``by`` group.

    Percentages are integers. ``linear`` interpolates between the two neighbours,
    ``nearest`` takes the row of rank ceil(n * p).
    """
    ranked = running_totals(hist, value, key, {"n": F.col("n")}, by)
    first, total = F.col("n_before"), F.col("n_total")

    def at(position: Column) -> Column:
        """Value at a zero-based position."""
        inside = (first <= position) & (position < first + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    outputs = []
    for name, percent in (linear or {}).items():
        scaled = (total - 1) * percent
        low = F.floor(scaled / 100).cast("bigint")
        fraction = F.max(F.pmod(scaled, F.lit(100))) / 100
        # the upper neighbour exists exactly when the fraction is above zero
        upper = at(low + 1)
        lower = at(low)
        outputs.append(
            F.when(fraction == 0, lower.cast("double"))
            .otherwise(
                lower.cast("double") + fraction * (upper.cast("double") - lower.cast("double"))
            )
            .alias(name)
        )
    for name, percent in (nearest or {}).items():
        rank = F.floor((total * percent + 99) / 100).cast("bigint")
        outputs.append(at(rank - 1).alias(name))
    return ranked.groupBy(*by).agg(*outputs)


def ntile_totals(values: DataFrame, value_cents: str, tiles: int) -> DataFrame:
    """Size, minimum, maximum and sum of each of ``tiles`` equal groups in value order.

    The first (rows mod tiles) groups hold one row more, as NTILE deals them.
    """
    ranked = running_totals(
        histogram(values, value_cents), value_cents, F.col(value_cents), {"n": F.col("n")}
    )
    total, before, n = F.col("n_total"), F.col("n_before"), F.col("n")
    size = F.floor(total / tiles).cast("bigint")
    extra = F.pmod(total, F.lit(tiles))
    long_rows = extra * (size + 1)

    def tile_of(rank: Column) -> Column:
        in_long = F.floor((rank - 1) / (size + 1)) + 1
        in_short = extra + F.floor(F.try_divide(rank - long_rows - 1, size)) + 1
        return F.when(rank <= long_rows, in_long).otherwise(in_short).cast("int")

    def end_of(tile: Column) -> Column:
        return tile * size + F.least(tile.cast("bigint"), extra)

    spread = ranked.select(
        F.col(value_cents).alias("v"),
        before.alias("before"),
        n.alias("n"),
        size.alias("size"),
        extra.alias("extra"),
        F.explode(F.sequence(tile_of(before + 1), tile_of(before + n))).alias("tile"),
    )
    size, extra, tile = F.col("size"), F.col("extra"), F.col("tile")
    taken = F.least(F.col("before") + F.col("n"), end_of(tile)) - F.greatest(
        F.col("before"), end_of(tile - 1)
    )
    return (
        spread.withColumn("taken", taken)
        .groupBy("tile")
        .agg(
            F.sum("taken").alias("rows"),
            F.min("v").alias("min_cents"),
            F.max("v").alias("max_cents"),
            F.sum(F.col("v") * F.col("taken")).alias("sum_cents"),
        )
    )


def entities_for_shares(
    values: DataFrame, value_cents: str, shares: Mapping[str, int], by: Sequence[str] = ()
) -> DataFrame:
    """How many of the largest entities reach each percentage of the total value.

    Output per group: ``entities`` and one column per entry of ``shares``. Values must not
    be negative.
    """
    ranked = running_totals(
        histogram(values, value_cents, by),
        value_cents,
        F.col(value_cents),
        {"n": F.col("n"), "v": F.col("n") * F.col(value_cents)},
        by,
        descending=True,
    )
    big = "decimal(38,0)"
    value = F.col(value_cents).cast(big)
    before, total = F.col("v_before").cast(big), F.col("v_total").cast(big)

    def reach(percent: int) -> Column:
        missing = total * percent - before * 100
        step = value * 100
        needed = F.ceil(F.try_divide(missing, step)).cast("bigint")
        crosses = (missing > 0) & (missing <= F.col("n").cast(big) * step)
        return F.min(F.when(crosses, F.col("n_before") + needed))

    return ranked.groupBy(*by).agg(
        F.max("n_total").alias("entities"),
        *[reach(percent).alias(name) for name, percent in shares.items()],
    )
