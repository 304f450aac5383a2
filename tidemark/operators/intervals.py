"""Least rows over intervals and points of days, by an index of dyadic spans.

A span of level l is the days k * 2**l to (k + 1) * 2**l - 1. An interval is the union
of its widest spans, at most two a level; a day lies in one span a level. So an
interval covers a day where one of its spans is one of the day's: an equi-join, and no
pair is formed that fails the range. A span keeps only the least row for each of 14
slots (days of a fortnight), so neither rows nor pairs of a hot key meet in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans of up to 2**21 days; the days of the years 0 to 9999 have 22 bits.
LEVELS = 22
SLOTS = 14


def day_number(d: Column) -> Column:
    """Days since the year 0, never negative for dates of years with four digits."""
    return F.unix_date(d) + 719_528


def levels_for(intervals: DataFrame, low: str, high: str) -> int:
    """How many levels the spans of these intervals have."""
    longest = intervals.agg(F.max(F.col(high) - F.col(low) + 1)).first()[0] or 1
    return min(LEVELS, max(1, longest.bit_length()))


def _levels(of: Callable[[Column], Column], levels: int) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), of))


def _halved(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c, level)


def spans_of(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The widest spans that make up the days low to high; none if low is above high."""

    def widest(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), level)
        first, last = _halved(low + width - 1, level), _halved(high + 1, level) - 1
        span = lambda k: F.struct(level.alias("level"), k.alias("span"))
        left = F.when((first <= last) & (first % 2 == 1), span(first))
        return F.array_compact(F.array(left, F.when((first <= last) & (last % 2 == 0), span(last))))

    return _levels(widest, levels)


def spans_at(day: Column, levels: int = LEVELS) -> Column:
    """The spans in which a day lies, one a level."""
    return _levels(lambda level: F.array(F.struct(level.alias("level"), _halved(day, level).alias("span"))), levels)


def _has(mask: str, slot: int) -> Column:
    return F.col(mask).bitwiseAND(1 << slot) != 0


def least_by_span(rows: DataFrame, key: list[str], spans: Column, row: str, mask: str) -> DataFrame:
    """(key, level, span, least0..): the least `row` of each slot in `mask`, summed where the rows are read."""
    flat = rows.select(*key, row, mask, F.explode(spans).alias("s")).select(*key, row, mask, "s.*")
    return flat.groupBy(*key, "level", "span").agg(*(F.min(F.when(_has(mask, k), F.col(row))).alias(f"least{k}") for k in range(SLOTS)))


def ask(queries: DataFrame, key: list[str], spans: Column, query: str, mask: str, index: DataFrame) -> DataFrame:
    """(query, found): the least row that a query's spans have in any slot of its mask, for those that have one."""
    flat = queries.select(*key, query, mask, F.explode(spans).alias("s")).select(*key, query, mask, "s.*")
    least = F.least(*(F.when(_has(mask, k), F.col(f"least{k}")) for k in range(SLOTS)))
    return flat.join(index, [*key, "level", "span"]).groupBy(query).agg(F.min(least).alias("found")).where("found is not null")
