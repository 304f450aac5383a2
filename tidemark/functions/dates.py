"""Dates in messy texts. Unreadable texts give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip

ISO, DMY = r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}/\d{1,2}/\d{4}$"
OUT = "dd/MM/yyyy"
_TIME = r"(?: (?:(?:0?[1-9]|1[0-2]):[0-5]?\d(?::[0-5]?\d)? [AaPp][Mm]|(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d)?))?$"
DMY_TIME, ISO_TIME = r"^\d{1,2}/\d{1,2}/\d{4}" + _TIME, r"^\d{4}-\d{1,2}-\d{1,2}" + _TIME


def strict_date(c: Column | str) -> Column:
    """yyyy-MM-dd, or day/month/year with four digits of the year."""
    value = strip(c)
    return F.coalesce(F.when(value.rlike(ISO), F.try_to_date(value, "yyyy-MM-dd")), F.when(value.rlike(DMY), F.try_to_date(value, "d/M/yyyy")))


#: Forms of a booking's date, day first, besides ISO.
FORMS = (
    r"\d{1,2}/\d{1,2}/\d{4}",
    r"\d{4}-\d{1,2}-\d{1,2}",
    r"\d{1,2}-\d{1,2}-\d{4}",
    r"\d{1,2}\.\d{1,2}\.\d{4}",
    r"\d{4}/\d{1,2}/\d{1,2}",
    r"\d{1,2}/\d{1,2}/\d{2}",
    r"\d{1,2}[ -][A-Za-z]{3,9}[ -]\d{4}",
    r"[A-Za-z]{3,9} \d{1,2},? \d{4}",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def booking_date(c: Column | str) -> Column:
    """A date in any of FORMS, with a 12-hour time, a 24-hour time or none.

    Blank texts and the first form, the usual ones, are told first and parsed as they
    are. For others one pattern tells the form, and the parts are put in order and parsed
    once, so that the expression stays small where it is copied into filters.
    """
    value = strip(c)
    month = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for name in dict.fromkeys((m, m[:3])) for x in (name, str(i))))
    named = lambda w: F.try_element_at(month, F.lower(w))

    def ordered(parts: Column) -> Column:
        a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
        word, first = a >= "A", F.length(a) == 4
        year = F.when(first & ~word, a).otherwise(F.when(F.length(c) == 2, F.concat(F.lit("20"), c)).otherwise(c))
        number = F.when(word, named(a)).when(first, b).otherwise(F.when(b >= "A", named(b)).otherwise(b))
        return F.try_to_date(F.concat(year, F.lit("-"), number, F.lit("-"), F.when(word, b).when(first, c).otherwise(a)), "yyyy-M-d")

    parts = F.when(value.rlike(f"^(?:{'|'.join(FORMS)}){_TIME}"), F.split(F.regexp_replace(value, _TIME, ""), "[-/., ]+"))
    other = F.get(F.transform(F.array(parts), ordered), F.lit(0))
    return F.when(value == "", None).when(value.rlike(DMY_TIME), F.try_to_date(F.substring_index(value, " ", 1), "d/M/yyyy")).otherwise(other)


def payment_date(c: Column | str) -> Column:
    """Day first, then ISO, then month first, then two-digit years, where 69 to 99 are of the last century."""
    value = strip(c)
    day = F.substring_index(value, " ", 1)
    short = F.when(value.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(day, "d/M/yy"))
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    slashes = value.rlike(DMY_TIME)
    return F.coalesce(F.when(slashes, F.try_to_date(day, "d/M/yyyy")), F.when(value.rlike(ISO_TIME), F.try_to_date(day, "yyyy-M-d")), F.when(slashes, F.try_to_date(day, "M/d/yyyy")), short)


def end_date(start: Column, override: str | None = None, default: str = "31/12/2026") -> Column:
    """For a blank end: the override, else the last day of the start's year, else the default."""
    if override:
        return F.lit(override)
    return F.coalesce(F.concat(F.lit("31/12/"), F.date_format(start, "yyyy")), F.lit(default))


def shown(d: Column) -> Column:
    return F.date_format(d, OUT)


def end_or_default(end: Column | str, start: Column, override: str | None = None) -> Column:
    """The end as dd/MM/yyyy; blank and unreadable ends get the default."""
    return F.coalesce(shown(booking_date(end)), end_date(start, override))
