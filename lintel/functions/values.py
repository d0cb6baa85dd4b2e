"""Column functions on dates, times, numbers and rendered values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def currency(code: Column) -> Column:
    """Trimmed upper case; pence count as pounds, since a factor cancels in ratios."""
    plain = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(plain == "GBX", "GBP").otherwise(plain)


def target_currency(symbol: Column) -> Column:
    """The last part of a symbol if it is a currency code, else empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(symbol, F.lit("")), ":"), lambda p: F.trim(p)), lambda p: p != "")
    last = F.upper(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))
    return F.when(last.rlike("^[A-Z]{3}$"), currency(last)).otherwise("")


def symbol_with(ticker: Column, suffix: str) -> Column:
    plain = F.trim(F.coalesce(ticker, F.lit("")))
    return F.when((plain == "") | F.contains(plain, F.lit(":")), plain).otherwise(F.concat(plain, F.lit(suffix)))


def blank(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))).isin("", "nan")


def percent(value: Column) -> Column:
    """'+1,234.5%' as a fraction; null without a percent sign or a number. A true minus sign counts."""
    plain = F.trim(F.translate(F.coalesce(value, F.lit("")), "−", "-"))
    return F.when(F.contains(plain, F.lit("%")), F.regexp_replace(plain, "[%,]", "").try_cast("double") / 100)


def period_start(end: Column, label: Column) -> Column:
    """First day of a named period that ends on a date; null for other labels."""
    plain = F.lower(F.trim(label))
    count = F.regexp_extract(plain, r"(\d+)\s*(month|year)s?", 1).try_cast("int")
    months = F.when(F.regexp_extract(plain, r"(\d+)\s*(month|year)s?", 2) == "year", count * 12).otherwise(count)
    return F.when(plain == "ytd", F.make_date(F.year(end), F.lit(1), F.lit(1))).otherwise(F.add_months(end, -months))


def as_of_date(text: Column) -> Column:
    """The date of 'as of Mon D YYYY' or null."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)as of ([A-Z][a-z]{2}) (\d{1,2}),? (\d{4})", 0)
    return F.try_to_date(F.regexp_replace(F.regexp_replace(found, "(?i)as of ", ""), ",", ""), "MMM d yyyy")


def timestamp_parts(seconds: Column) -> tuple[Column, Column, Column, Column]:
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000, 0)).cast("long")
    return F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000


def subtitle_time(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm with as many hour digits as needed."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", *timestamp_parts(seconds))


def duration(seconds: Column) -> Column:
    """MM:SS or H:MM:SS; 'unknown' for what is no duration."""
    known = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    whole = F.when(known, seconds).otherwise(0).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(~known, "unknown").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def clock_seconds(value: Column) -> Column:
    """Seconds of HH:MM:SS.ffffff or null."""
    parts = F.split(F.trim(value), ":")
    hms = [F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2, 3)]
    return F.when(F.size(parts) == 3, hms[0] * 3600 + hms[1] * 60 + hms[2])


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
