"""Dates from text, spans of partial dates, statuses against a given day; the clock is never read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd")


def parsed(value: Column, formats: Sequence[str] = FORMATS) -> Column:
    """A date from text: ordinal endings go, of a range of days the first counts; null where no format fits."""
    text = F.trim(F.regexp_replace(F.regexp_replace(value, r"(\d)(st|nd|rd|th)\b", "$1"), r"(\d)\s*[-–]\s*\d{1,2}(,|\s)", "$1$2"))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def partial(value: Column) -> Column:
    """struct(first, last, exact) of a day, a month, a year or a season with a year; null where none of these."""
    text = F.trim(value)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))
    year = F.regexp_extract(text, r"^(?i)(?:spring|summer|fall|autumn|winter)?\s*(\d{4})$", 1).try_cast("int")
    season = F.lower(F.regexp_extract(text, r"^(?i)(spring|summer|fall|autumn|winter)\s+\d{4}$", 1))
    start = F.when(season == "spring", 3).when(season == "summer", 6).when(season.isin("fall", "autumn"), 9).when(season == "winter", 12).otherwise(1)
    months = F.when(season == "", 12).when(season == "winter", 1).otherwise(3)
    opened = F.try_make_timestamp(years=year, months=start, days=F.lit(1), hours=F.lit(0), mins=F.lit(0), secs=F.lit(0)).cast("date")
    made = lambda a, b, e: F.struct(a.alias("first"), b.alias("last"), F.lit(e).alias("exact"))
    return F.when(day.isNotNull(), made(day, day, True)).when(month.isNotNull(), made(month, F.last_day(month), False)).when(year.isNotNull(), made(opened, F.last_day(F.add_months(opened, months - 1)), False))


def span(start: Column, end: Column) -> Column:
    """struct(first, last): the end counts only where it is not before the start."""
    return F.struct(start.alias("first"), F.when(end >= start, end).otherwise(start).alias("last"))


def status(first: Column, last: Column, today: Column) -> Column:
    return F.when(first.isNull(), "date unconfirmed").when(last < today, "past").otherwise("upcoming")


def shown(first: Column, last: Column) -> Column:
    """One day, or two days of a range."""
    one = lambda d: F.date_format(d, "d MMM yyyy")
    return F.when(first.isNull(), "date unconfirmed").when(first == last, one(first)).otherwise(F.concat(one(first), F.lit(" - "), one(last)))


def us_date(value: Column) -> Column:
    """MM/DD/YYYY or ISO without a time, years 1900 to 2100."""
    text = F.trim(value)
    day = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.when(F.year(day).between(1900, 2100), day)


def years(value: Column) -> Column:
    """Years named in a text, fiscal years such as FY24 among them, in order of value."""
    full = F.transform(F.regexp_extract_all(value, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    fiscal = F.transform(F.regexp_extract_all(value, F.lit(r"\bFY ?(\d{2})\b"), F.lit(1)), lambda y: y.cast("int") + 2000)
    return F.array_sort(F.array_distinct(F.concat(full, fiscal)))


def newest_year(value: Column, this_year: int, ahead: int = 5) -> Column:
    return F.array_max(F.filter(years(value), lambda y: y <= this_year + ahead))


def funding_status(start: Column, end: Column, today: Column, recent: int = 365) -> Column:
    return (
        F.when(start.isNull() & end.isNull(), "undated")
        .when(end >= today, "active")
        .when(end.isNull() & (F.datediff(today, start) <= recent), "recent_award")
        .when(F.datediff(today, end) <= recent, "recently_completed")
        .otherwise("historical")
    )


def month(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM"), F.lit("unknown"))


def dated_prefix(value: Column) -> Column:
    """struct(day, title) of "2024-05-01: title" or "May 1, 2024 - title"; day is null where no date leads."""
    pattern = r"^\s*(\d{4}-\d{2}-\d{2}|[A-Z][a-z]+ \d{1,2}, \d{4})\s*[:–-]\s*(.*)$"
    day = parsed(F.regexp_extract(value, pattern, 1))
    return F.struct(day.alias("day"), F.when(day.isNull(), F.trim(value)).otherwise(F.regexp_extract(value, pattern, 2)).alias("title"))


def freshness(days: Column, windows: Sequence[int] = (90, 180, 365)) -> Column:
    """The first window that the age in days fits, null beyond the last."""
    out = F.when(F.lit(False), F.lit(None))
    for w in windows:
        out = out.when(days <= w, F.lit(w))
    return out


def stalled(started: Column, now: Column, seconds: int) -> Column:
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(started.cast("timestamp")) > seconds
