"""Date expressions.  The present is always a parameter; parsers give null for what they cannot read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Fixed values: (pattern the whole text must match, format).  Length decides between digit-only forms.
FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}\.?$", "yyyy.M.d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{6}$", "yyyyMM"),
    (r"^\d{12}$", "yyyyMMddHHmm"),
    (r"^\d{14}$", "yyyyMMddHHmmss"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?.*$", "yyyy-MM-dd"),
)


def any_date(c: Column | str) -> Column:
    """Date from any of the known forms; yyyymm is the first of the month."""
    t = F.regexp_replace(F.trim(col(c).cast("string")), r"\.$", "")
    out = F.lit(None).cast("date")
    for pattern, form in reversed(FORMATS):
        if form == "yyyyMM":
            parsed = F.try_to_timestamp(F.concat(t, F.lit("01")), F.lit("yyyyMMdd"))
        elif form == "yyyy-MM-dd":
            parsed = F.try_to_timestamp(F.substring(t, 1, 10), F.lit(form))
        else:
            parsed = F.try_to_timestamp(t, F.lit(form))
        out = F.when(F.rlike(t, F.lit(pattern)), parsed.cast("date")).otherwise(out)
    return out


def article_time(c: Column | str) -> Column:
    """Timestamp in UTC from 14 digits or ISO text; without a zone the time is UTC."""
    t = F.trim(col(c))
    return F.when(F.rlike(t, F.lit(r"^\d{14}$")), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss"))).otherwise(F.try_to_timestamp(t))


def mail_time(c: Column | str) -> Column:
    """Timestamp from an RFC 2822 date; the weekday is ignored."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(col(c)), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def dates_in(text: Column | str) -> Column:
    """Dates written in a text with ., -, / or year-month-day signs, in order, distinct."""
    t = F.coalesce(col(text), F.lit(""))
    pattern = r"(?:19|20)\d{2}\s*[./년-]\s*\d{1,2}\s*[./월-]\s*\d{1,2}"
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    parts = F.transform(found, lambda s: F.regexp_replace(F.regexp_replace(s, r"[^0-9]+", "-"), "^-|-$", ""))
    return F.array_distinct(F.array_compact(F.transform(parts, lambda s: F.try_to_timestamp(s, F.lit("yyyy-M-d")).cast("date"))))


def due_soon(due: Column | str, as_of: Column, days: int = 7) -> Column:
    """Due from today to so many days ahead, both ends included; false without a date."""
    d = F.to_date(col(due))
    return F.coalesce((d >= as_of) & (d <= F.date_add(as_of, days)), F.lit(False))


def lifecycle(due: Column | str, now: Column, zone: str = "Asia/Seoul") -> Column:
    """Struct (status, days_until, closed_at): dates count in the zone, the due time is UTC."""
    due_day = F.to_date(F.from_utc_timestamp(col(due), zone))
    today = F.to_date(F.from_utc_timestamp(now, zone))
    days = F.datediff(due_day, today)
    status = F.when(due_day.isNull(), "unknown").when(days >= 0, "active").otherwise("closed")
    return F.struct(status.alias("status"), days.alias("days_until"), F.when(days < 0, due_day).alias("closed_at"))


def month_start(day: Column, months: int) -> Column:
    """First day of the month so many months on."""
    return F.trunc(F.add_months(day, months), "MM").cast("date")


def windows(start: Column, end: Column, days: int = 7) -> Column:
    """Array of (begin, end) date windows of at most so many days that cover [start, end]."""
    begins = F.sequence(start, end, F.expr(f"interval {days} days"))
    return F.transform(begins, lambda d: F.struct(d.alias("begin"), F.least(F.date_add(d, days - 1), end).alias("end")))


def day_label(due: Column | str, as_of: Column) -> Column:
    """D-n before the deadline, D-Day on it, D+n after it; null without one."""
    n = F.datediff(due, as_of)
    return F.when(n > 0, F.concat(F.lit("D-"), n.cast("string"))).when(n == 0, "D-Day").when(n < 0, F.concat(F.lit("D+"), (-n).cast("string")))
