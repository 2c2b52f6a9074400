"""Column expressions every report shares, so a rule is written once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarscope.functions import domain as D

SECONDS_PER_DAY = 86400


# -- numbers ---------------------------------------------------------------------
def rounded(value: Column, digits: int = 2) -> Column:
    """Round half up, as a double.

    The first rounding removes binary noise: a quotient that is 16.025 in decimal
    arithmetic rounds to 16.03 however its double was computed.
    """
    return F.round(F.round(value.cast("double"), 9), digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; NULL, not zero, where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def avg2(numerator: Column, denominator: Column) -> Column:
    return rounded(ratio(numerator, denominator))


def raw_pct(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def pct(part: Column, whole: Column) -> Column:
    return rounded(raw_pct(part, whole))


def growth_pct(current: Column, previous: Column) -> Column:
    return pct(current.cast("double") - previous.cast("double"), previous)


def rows_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_where(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def cents(money: Column) -> Column:
    """Money as whole cents: sums are exact, order-free and cheap long additions.

    The product is within half a cent of a whole number for amounts below 10**13.
    """
    return F.rint(money.cast("double") * 100).cast("bigint")


def cents_sum(column: str, where: Column | None = None) -> Column:
    """Sum of a money column in cents; 0 for a condition that no row meets."""
    value = cents(F.col(column))
    return F.sum(value) if where is None else sum_where(where, value)


def money(cents_column: str) -> Column:
    """Cents back to an amount with two digits, as a double."""
    return rounded(F.col(cents_column) / 100)


def avg_money(cents_column: str, n: Column) -> Column:
    return avg2(F.col(cents_column) / 100, n)


def decimal_money(cents_column: Column) -> Column:
    """Cents back to a decimal amount, for stored facts."""
    return (cents_column.cast("decimal(18,0)") / 100).cast("decimal(18,2)")


# -- time ------------------------------------------------------------------------
def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds between two zone-free timestamps; no session zone is involved."""
    return (end - start).cast("interval second").cast("bigint")


def avg_days2(seconds: Column, n: Column) -> Column:
    return rounded(ratio(seconds, n) / SECONDS_PER_DAY)


# -- orders ----------------------------------------------------------------------
def is_completed() -> Column:
    return F.col("order_status") == D.COMPLETED_STATUS


def is_delivery_eligible() -> Column:
    return (
        is_completed()
        & F.col("order_delivered_customer_date").isNotNull()
        & F.col("order_estimated_delivery_date").isNotNull()
    )


def is_late() -> Column:
    return F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")


def banded(value: Column, bands, rest: str) -> Column:
    """Label of the first band whose upper bound the value does not exceed."""
    expr = F.when(value <= bands[0][0], bands[0][1])
    for bound, label in bands[1:]:
        expr = expr.when(value <= bound, label)
    return expr.otherwise(rest)


def delay_band(delay_seconds: Column) -> Column:
    bands = [(days * SECONDS_PER_DAY, label) for days, label in D.DELAY_BANDS]
    return banded(delay_seconds, bands, D.DELAY_BAND_REST)


def installment_band(installments: Column) -> Column:
    return banded(installments, D.INSTALLMENT_BANDS, D.INSTALLMENT_BAND_REST)


def position_in(label: Column, bands, rest: str) -> Column:
    """Sort position of a band label."""
    order = [name for _, name in bands] + [rest]
    return F.array_position(F.array(*[F.lit(x) for x in order]), label)


# -- categories ------------------------------------------------------------------
def category_label(english: Column, source: Column) -> Column:
    return F.coalesce(english, source, F.lit(D.UNKNOWN_CATEGORY))


# -- text ------------------------------------------------------------------------
SPACES = r"[\s\x1c-\x1f]"  # with the flag U


def _plain_ends(text: Column) -> Column:
    """Begins and ends with a visible ASCII character, as most text does: no pattern is tried then.

    Bytes are looked at, as characters would be counted from the start for each look.
    """
    first, last = (F.substring(text.cast("binary"), at, 1) for at in (1, -1))
    low, high = F.lit(b"!"), F.lit(b"~")
    return (first >= low) & (first <= high) & (last >= low) & (last <= high)


def stripped(text: Column) -> Column:
    """Text without surrounding Unicode white space; the ASCII separators 1C to 1F count too."""
    bare = F.regexp_replace(text, rf"(?U)^{SPACES}+|{SPACES}+$", "")
    return F.when(_plain_ends(text), text).otherwise(bare)


def is_padded(text: Column) -> Column:
    """Surrounded by white space that ``stripped`` removes."""
    return F.when(_plain_ends(text), F.lit(False)).otherwise(text.rlike(rf"(?U)^{SPACES}|{SPACES}$"))


def is_blank(text: Column) -> Column:
    """Only white space, one character at least."""
    return F.when(_plain_ends(text), F.lit(False)).otherwise(text.rlike(rf"(?U)^{SPACES}+$"))


def untidiness(text: Column, null: int, empty: int, blank: int, padded: int) -> Column:
    """The number of what is the matter with a text, 0 if it is tidy; what is blank is padded too.

    The same as ``is_blank`` and ``is_padded``, with one look at the ends of most text.
    """
    return (
        F.when(text.isNull(), null)
        .when(_plain_ends(text), 0)
        .when(text == "", empty)
        .when(text.rlike(rf"(?U)^{SPACES}+$"), blank)
        .when(text.rlike(rf"(?U)^{SPACES}|{SPACES}$"), padded)
        .otherwise(0)
    )


def blank_to_null(text: Column) -> Column:
    return F.nullif(stripped(text), F.lit(""))
