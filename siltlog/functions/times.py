"""Timestamp parsing, buckets and labels. The session zone is UTC."""

from pyspark.sql import Column, functions as F

from siltlog.functions.text import SPACE

# Output formats.
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
HOUR_LABEL = "yyyy-MM-dd'T'HH:00"
UNKNOWN_HOUR = "unknown-time"


def _millis(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts)


def error_log_time(text: Column) -> Column:
    """``Sun Dec 04 04:47:44 2005``, weekday ignored, fraction optional; else ISO; else null."""
    date = F.regexp_extract(text, rf"^(?:[A-Za-z]+,?{SPACE}+(?=[A-Za-z]))?(.*)", 1)
    # Single-digit days may be padded with a second space.
    single_spaced = F.replace(date, F.lit("  "), F.lit(" "))
    calendar = F.try_to_timestamp(single_spaced, F.lit("MMM d HH:mm:ss[.SSSSSS] yyyy"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return _millis(F.coalesce(calendar, iso))


def access_log_time(text: Column) -> Column:
    """``01/Jul/2026:14:58:44 +0000``; a missing offset means UTC."""
    zoned = F.when(F.instr(text, " ") > 0, text).otherwise(F.concat(text, F.lit(" +0000")))
    return _millis(F.try_to_timestamp(zoned, F.lit("d/MMM/yyyy:HH:mm:ss Z")))


def bound_time(text: str) -> Column:
    """A caller's time bound; null when it cannot be read. Folds to a literal."""
    value = F.lit(text)
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), value.try_cast("timestamp"))
    return F.coalesce(iso, error_log_time(value))


def report_time(text: Column) -> Column:
    """Event times written by a model: 12-hour ``DD/MM/YYYY`` in either order, or ISO."""
    formats = (
        "d/M/yyyy h:mm:ss a",
        "d/M/yyyy h:mm a",
        "h:mm:ss a d/M/yyyy",
        "h:mm a d/M/yyyy",
        "yyyy-MM-dd'T'HH:mm",
    )
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return F.coalesce(iso, *tries)


def bucket_start(ts: Column, minutes: int = 15) -> Column:
    """Start of the N-minute bucket within the hour."""
    hour = F.date_trunc("hour", ts)
    into = F.floor(F.minute(ts) / minutes) * minutes
    return F.timestamp_seconds(F.unix_seconds(hour) + into * 60)


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def hour_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, HOUR_LABEL), F.lit(UNKNOWN_HOUR))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_MILLIS)
