"""Dates, times and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_millis(start: Column, end: Column) -> Column:
    """Milliseconds from start to end, null unless both are times."""
    return F.unix_millis(end) - F.unix_millis(start)


def duration_iso(start: Column, end: Column) -> Column:
    """ISO-8601 duration with all its fields; the sign goes in front."""
    ms = duration_millis(start, end)
    s = F.abs(ms)
    days, rest = F.floor(s / 86_400_000), s % 86_400_000
    text = F.format_string("P0Y0M%dDT%dH%dM%s.%03dS", days, F.floor(rest / 3_600_000), F.floor(rest % 3_600_000 / 60_000), F.floor(rest % 60_000 / 1000).cast("string"), rest % 1000)
    return F.when(ms < 0, F.concat(F.lit("-"), text)).otherwise(text)


#: ``duration_iso`` of timestamps ``a`` and ``b`` as SQL text.
DURATION_SQL = (
    "concat(if(unix_millis(b) < unix_millis(a), '-', ''), format_string('P0Y0M%dDT%dH%dM%d.%03dS', abs(unix_millis(b) - unix_millis(a)) div 86400000, abs(unix_millis(b) - unix_millis(a)) % 86400000 div 3600000, "
    "abs(unix_millis(b) - unix_millis(a)) % 3600000 div 60000, abs(unix_millis(b) - unix_millis(a)) % 60000 div 1000, abs(unix_millis(b) - unix_millis(a)) % 1000))"
)


def scaled(duration: Column, by: Column) -> Column:
    """A day-time interval times a number."""
    return F.make_dt_interval(secs=seconds_of(duration) * by)


def ratio(a: Column, b: Column) -> Column:
    """How often interval ``b`` goes into ``a``; null if ``b`` is nothing."""
    return F.try_divide(seconds_of(a), seconds_of(b))


def shorter(a: Column, b: Column) -> Column:
    return F.least(a, b)


def longer(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def seconds_of(duration: Column) -> Column:
    """Seconds of a day-time interval, with their fraction."""
    part = lambda unit: F.extract(F.lit(unit), duration)
    return (part("DAY") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60 + part("SECOND")).cast("decimal(28,6)")


def epoch_millis(text: Column) -> Column:
    """Milliseconds of a date (its midnight) or time in ISO form, null for anything else."""
    return F.unix_millis(F.try_to_timestamp(text))


def iso_offset(text: Column) -> Column:
    """A time whose offset lacks the colon, as a timestamp."""
    return F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"))


def lenient_date(text: Column) -> Column:
    """``date:``, ``year:`` or ``monthday:`` and the value, by the form of the text."""
    return (
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat(F.lit("date:"), F.date_format(F.try_to_date(text, "M/d/yyyy"), "yyyy-MM-dd")))
        .when(text.rlike(r"^\d{4}$"), F.concat(F.lit("year:"), text))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}$"), F.concat(F.lit("monthday:--"), F.lpad(F.split_part(text, F.lit("/"), F.lit(1)), 2, "0"), F.lit("-"), F.lpad(F.split_part(text, F.lit("/"), F.lit(2)), 2, "0")))
    )


def day_time_duration(weeks: Column, days: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    return F.make_dt_interval(weeks * 7 + days, hours, minutes, seconds)


def birthday(d: Column) -> Column:
    """A date; the year 1970 stands for none and leaves month and day."""
    return F.when(F.year(d) == 1970, F.concat(F.lit("--"), F.date_format(d, "MM-dd"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
