"""Analysis windows: one core period and matched periods of consecutive years."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _instant(day: str) -> Column:
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


@dataclass(frozen=True)
class Window:
    """Half-open range of purchase time."""

    start: str
    end: str

    def contains(self, ts: Column) -> Column:
        return (ts >= _instant(self.start)) & (ts < _instant(self.end))


@dataclass(frozen=True)
class Periods:
    core: Window
    matched: tuple[tuple[int, Window], ...]

    @property
    def years(self) -> tuple[int, ...]:
        return tuple(year for year, _ in self.matched)

    def in_core(self, ts: Column) -> Column:
        return self.core.contains(ts)

    def in_matched(self, ts: Column) -> Column:
        return reduce(lambda a, b: a | b, (w.contains(ts) for _, w in self.matched))

    def in_year(self, ts: Column, year: int) -> Column:
        return dict(self.matched)[year].contains(ts)


def january_to_august(first_year: int) -> Periods:
    """Core: 20 months from January; matched: January to August of both years."""
    second = first_year + 1
    return Periods(
        core=Window(f"{first_year}-01-01", f"{second}-09-01"),
        matched=tuple((y, Window(f"{y}-01-01", f"{y}-09-01")) for y in (first_year, second)),
    )


PUBLISHED = january_to_august(2017)
