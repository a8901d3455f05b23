"""Times: instants are seconds since 1970 in UTC, whatever the session's zone."""

from __future__ import annotations

import calendar
import datetime as dt
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def moment(seconds: str) -> Column:
    """A column of seconds as a timestamp without zone."""
    return F.expr(f"dateadd(SECOND, {seconds}, {_EPOCH})")


def seconds(timestamp: str) -> Column:
    """Seconds of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, {_EPOCH}, {timestamp})")


def year_of(column: str = "published") -> Column:
    return F.date_format(moment(column), "yyyy")


def quarter_of(column: str = "published") -> Column:
    t = moment(column)
    return F.concat(F.date_format(t, "yyyy"), F.lit("-Q"), F.quarter(t).cast("string"))


def month_of(column: str = "published") -> Column:
    return F.date_format(moment(column), "yyyy-MM")


def week_of(column: str = "published") -> Column:
    """The Monday of the week."""
    day = moment(column).cast("date")
    return F.date_format(F.date_sub(day, F.weekday(day)), "yyyy-MM-dd")


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO timestamp; without a zone it is UTC; null if it isn't one."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(text, r"(?i)z$", "+00:00")))


def day_seconds(text: Column) -> Column:
    """Seconds at midnight UTC of YYYY-MM-DD; null for a day that doesn't exist."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * DAY


def day_end(from_midnight: Column) -> Column:
    return from_midnight + (DAY - 1)


def lenient_day(text: str, end: bool = False) -> dt.date | None:
    """A day from 2025, 2025-3, 2025-03-04 or 20250304: the first or the last one that is meant."""
    text = text.strip()
    m = re.fullmatch(r"(\d{4})(?:[-/.](\d{1,2})(?:[-/.](\d{1,2}))?)?|(\d{4})(\d{2})(\d{2})", text)
    if not m:
        return None
    year, month, day = (int(x) if x else None for x in (m[1] or m[4], m[2] or m[5], m[3] or m[6]))
    try:
        if month is None:
            return dt.date(year, 12, 31) if end else dt.date(year, 1, 1)
        if day is None:
            return dt.date(year, month, calendar.monthrange(year, month)[1] if end else 1)
        return dt.date(year, month, day)
    except (ValueError, calendar.IllegalMonthError):
        return None


def monday(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def years_back(day: dt.date, n: int) -> dt.date:
    """The Monday of the week that lies n years before; 29 February counts as the 28th."""
    try:
        return monday(day.replace(year=day.year - n))
    except ValueError:
        return monday(day.replace(year=day.year - n, day=28))


def span(first: dt.date, last: dt.date, grain: str) -> int:
    """How many buckets of the grain the days from first to last touch."""
    if last < first:
        return 0
    months = (last.year - first.year) * 12 + last.month - first.month
    quarters = (last.year * 4 + (last.month - 1) // 3) - (first.year * 4 + (first.month - 1) // 3)
    return {"year": last.year - first.year, "quarter": quarters, "month": months, "week": (monday(last) - monday(first)).days // 7}[grain] + 1


def coarsen(first: dt.date, last: dt.date, grain: str, cap: int) -> str:
    """The finest grain, from ``grain`` upwards, that stays within the cap."""
    order = ["week", "month", "quarter", "year"]
    return next((g for g in order[order.index(grain) :] if span(first, last, g) <= cap), "year")


# After how many seconds the corpus is stale, the catalog of exploited records is, and a copy syncs by itself.
STALE, KEV_STALE, AUTO_SYNC = 2 * DAY, 8 * DAY, DAY // 2


def age_phrase(seconds_ago: float) -> str:
    """How old in hours or days."""
    if seconds_ago < 3_600:
        return "less than an hour old"
    unit, size = ("hour", 3_600) if seconds_ago < DAY else ("day", DAY)
    n = int(seconds_ago // size)
    return f"{n} {unit}{'s' * (n != 1)} old"


def is_stale(seconds_ago: float, limit: float = STALE) -> bool:
    return seconds_ago > limit


def freshness(generated, now: float, limit: float = STALE) -> dict | None:
    """Age in seconds (none below zero), the moment, the phrase and whether it is stale; None if there is no usable time."""
    if isinstance(generated, bool) or not isinstance(generated, (int, float)) or not math.isfinite(generated) or generated <= 0:
        return None
    age = max(0.0, now - generated)
    return {"age": age, "iso": dt.datetime.fromtimestamp(generated, dt.UTC).isoformat(), "phrase": age_phrase(age), "stale": is_stale(age, limit)}


# The names of the ranges that a day offers, cut to the data and open at the end.
SHORTCUTS = "30d 90d 12m 24m ytd prev-year".split()
QUICK = "10y 5y 2y 1y ytd".split()


def shortcut(name: str, today: Column) -> tuple[Column, Column]:
    """First and last day of a range that a name stands for: a number of days or months up to today, years back to the Monday of that week, ``ytd`` (this year so far) or ``prev-year``."""
    year = F.trunc(today, "YEAR")
    if name == "prev-year":
        return F.add_months(year, -12), F.date_sub(year, 1)
    if name == "ytd":
        return year, today
    back, unit = -int(name[:-1]), name[-1]
    if unit == "d":
        return F.date_add(today, back + 1), today
    before = F.add_months(today, back * (12 if unit == "y" else 1))
    return (F.trunc(before, "WEEK") if unit == "y" else F.date_add(before, 1)), today


def ranges(days: DataFrame, names: list[str], low: Column | None = None, high: Column | None = None, today: str = "today") -> DataFrame:
    """The columns of ``days`` and name, first, last: of each day the ranges that touch the days from low to high, cut to them, after one over all (``all``, without bounds)."""
    told = [(F.lit("all"), F.lit(None).cast("date"), F.lit(None).cast("date"))] + [(F.lit(n), *shortcut(n, F.col(today))) for n in names]
    each = F.explode(F.array(*[F.struct(n.alias("name"), a.alias("first"), b.alias("last")) for n, a, b in told]))
    rows = days.select("*", each.alias("__range")).select(*days.columns, "__range.*")
    if low is not None:
        rows = rows.filter((F.col("name") == "all") | (F.col("last") >= low)).withColumn("first", F.when(F.col("first").isNotNull(), F.greatest("first", low)))
    if high is not None:
        rows = rows.filter((F.col("name") == "all") | (F.col("first") <= high)).withColumn("last", F.when(F.col("last").isNotNull(), F.least("last", high)))
    return rows


def opened(days: DataFrame, today: str = "today") -> DataFrame:
    """The columns of ``days`` and name, first of the ranges that end with the data."""
    return ranges(days, QUICK, today=today).drop("last")
