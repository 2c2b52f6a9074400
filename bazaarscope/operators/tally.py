"""Row rules, keys and value counts of many tables from one scan of each and one shuffle.

Every row of a source yields one element with a bit set of the rules it meets, one for each of its
keys and one for each value to be counted. All elements of all sources are grouped together:
equal bit sets, keys and values meet on the map side first, so frequent ones cost nothing. A key
may be shared by up to four sources, each in a slot of its own; slot 0 is the side the others
refer to.

Keys travel as 128-bit digests: two of n keys are taken for one with probability n^2 / 2^129.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
SLOTS = 4
MAX_RULES = 62
_ELEMENT = "struct<kind:int,a:bigint,b:bigint,v:double,slot:int>"


def digest(columns: Sequence[Column]) -> tuple[Column, Column]:
    """128 bits of a row of values; NULL is a value of its own."""
    parts = [x for column in columns for x in (column, column.isNull())]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


Rule = tuple[str | tuple[str, ...], Column]


def labels_of(rules: Sequence[Rule]) -> list[str]:
    return [x for label, _ in rules for x in ((label,) if isinstance(label, str) else label)]


def bits(rules: Sequence[Rule]) -> Column:
    """The set of rules a row meets; an unknown rule is not met.

    A rule is a label with a condition, or some labels with a number that has a bit for each
    of them: rules that exclude each other are cheaper as one case expression.
    """
    out, at = F.lit(0).cast("bigint"), 0
    for label, test in rules:
        if isinstance(label, str):
            out, at = out + F.when(test, F.lit(1 << at).cast("bigint")).otherwise(F.lit(0).cast("bigint")), at + 1
        else:
            out, at = out + F.coalesce(test, F.lit(0)) * F.lit(1 << at).cast("bigint"), at + len(label)
    if at > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules fit a set")
    return out


@dataclass
class Key:
    """``columns`` of a source under the name ``topic``."""

    topic: str
    columns: Sequence[Column]
    slot: int = 0
    skip_null: bool = False  # rows whose (single) column is NULL do not refer to anything
    where: Column | None = None


@dataclass
class Source:
    """``name``, rows, rules, keys, and values ``(topic, column)`` to count.

    ``weight`` is the number of rows that each row stands for. A source of ``few`` rules needs no
    expansion of its rows.
    """

    name: str
    rows: DataFrame
    rules: list[Rule] = field(default_factory=list)
    keys: list[Key] = field(default_factory=list)
    values: list[tuple[str, Column]] = field(default_factory=list)
    weight: Column = field(default_factory=lambda: F.lit(1))
    few: bool = False  # rules and keys fit one compiled method


class Tally:
    """The grouped elements of some sources."""

    def __init__(self, sources: Sequence[Source]) -> None:
        self._rules = {s.name: labels_of(s.rules) for s in sources}
        topics = [k.topic for s in sources for k in s.keys] + [t for s in sources for t, _ in s.values]
        names = [s.name for s in sources]
        self._names = [*names, *dict.fromkeys(t for t in topics if t not in names)]
        self._values = {t for s in sources for t, _ in s.values}
        parts = [self._elements(s) for s in sources]
        elements = reduce(DataFrame.unionAll, parts)
        sums = [
            F.sum(F.when(c("slot") == i, c("w")).otherwise(0)).alias(f"n{i}") for i in range(SLOTS)
        ]
        self._grouped = elements.groupBy("kind", "a", "b", "v").agg(*sums)

    def _element(self, topic: str, a: Column, b: Column, v: Column, slot: int) -> Column:
        return F.struct(
            F.lit(self._names.index(topic)).alias("kind"), a.alias("a"), b.alias("b"),
            v.cast("double").alias("v"), F.lit(slot).alias("slot"),
        )

    def _elements(self, source: Source) -> DataFrame:
        none, zero = F.lit(None).cast(_ELEMENT), F.lit(0).cast("bigint")
        out = [self._element(source.name, bits(source.rules), zero, F.lit(None), 0)]
        for key in source.keys:
            element = self._element(key.topic, *digest(key.columns), F.lit(None), key.slot)
            if key.skip_null:
                element = F.when(key.columns[0].isNotNull(), element).otherwise(none)
            if key.where is not None:
                element = F.when(key.where, element).otherwise(none)
            out.append(element)
        for topic, value in source.values:
            out.append(F.when(value.isNotNull(), self._element(topic, zero, zero, value, 0)).otherwise(none))
        weight = source.weight.cast("bigint").alias("w")
        if source.few:
            rows = source.rows.select(weight, F.explode(F.array(*out)).alias("e"))
        else:
            # columns first, rows afterwards: a generator would evaluate all elements in one method,
            # or without generated code
            named = [element.cast(_ELEMENT).alias(f"e{i}") for i, element in enumerate(out)]
            wide = source.rows.select(weight, *named)
            rows = wide.unpivot("w", [f"e{i}" for i in range(len(out))], "of", "e")
        return rows.where("e IS NOT NULL").select("w", "e.kind", "e.a", "e.b", "e.v", "e.slot")

    def summary(self) -> DataFrame:
        """``topic, item, value`` and the statistics of every slot.

        A source has an item for every rule, and '*' for all its rows. A key has one row with
        item ''. Counted values have a row per value, so the summary is to be written as a table
        before it is read more than once.
        """
        sources = list(self._rules)
        labels = F.array(*(F.array(F.lit("*"), *map(F.lit, self._rules[s])) for s in sources))
        met = F.expr(
            "filter(transform(own, (l, i) -> if(i = 0 OR bit_get(a, greatest(i - 1, 0)) = 1, l, NULL)), "
            "l -> l IS NOT NULL)"
        )
        is_source = c("kind") < len(sources)
        own = F.when(is_source, F.get(labels, c("kind"))).otherwise(F.array(F.lit("*")))
        rows = self._grouped.withColumn("own", own).select(
            "kind", F.explode(F.when(is_source, met).otherwise(F.array(F.lit("")))).alias("item"),
            c("v").alias("value"), *(f"n{i}" for i in range(SLOTS)),
        )
        wide = [x.cast("bigint").alias(f"{name}_{i}") for i in range(SLOTS) for name, x in _statistics(i).items()]
        topic = F.element_at(F.array(*map(F.lit, self._names)), c("kind") + 1).alias("topic")
        return rows.groupBy("kind", "item", "value").agg(*wide).select(
            topic, "item", "value", *(f"{name}_{i}" for i in range(SLOTS) for name in STATISTICS)
        )


STATISTICS = (
    "rows", "distinct", "repeated_rows", "repeated", "largest", "orphan_rows", "orphans", "childless",
)


def _statistics(slot: int) -> dict[str, Column]:
    """Of the groups of a key: rows and keys in the slot, rows and number of repeated keys, the
    largest group, rows and keys that slot 0 lacks, and rows of slot 0 that the slot lacks."""
    n, known = c(f"n{slot}"), c("n0") > 0

    def total(test: Column, of: Column = n) -> Column:
        return F.coalesce(F.sum(F.when(test, of)), F.lit(0))

    found = (
        total(F.lit(True)), F.count_if(n > 0), total(n > 1), F.count_if(n > 1), F.max(n),
        total(~known), F.count_if(~known & (n > 0)), total(n == 0, c("n0")),
    )
    return dict(zip(STATISTICS, found, strict=True))


def counts(summary: DataFrame) -> DataFrame:
    """``topic, item, statistic, n`` of a stored summary: ``rows`` of the rules of a source, every
    statistic of a key with its slot as item."""
    some = summary.where("value IS NULL")
    rules = some.where("item <> ''").select(
        "topic", "item", F.lit("rows").alias("statistic"), c("rows_0").alias("n")
    )
    cells = [
        F.struct(F.lit(str(i)).alias("item"), F.lit(name).alias("statistic"), c(f"{name}_{i}").alias("n"))
        for i in range(SLOTS) for name in STATISTICS
    ]
    return rules.unionByName(some.where("item = ''").select("topic", F.inline(F.array(*cells))))


def histogram(summary: DataFrame) -> DataFrame:
    """``topic, value, n`` of the values counted in a stored summary."""
    return summary.where("value IS NOT NULL").select("topic", "value", c("rows_0").alias("n"))
