"""Dates and epoch milliseconds. Every conversion uses the session's time zone, so set spark.sql.session.timeZone once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE, DATE_TIME, PARTITION = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd"


def millis_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def date_time_to_millis(text: Column) -> Column:
    """Null where the text is no date and time."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(DATE_TIME)))


def date_to_millis(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text, F.lit(DATE)))


def millis_to_text(ms: Column, pattern: str = DATE_TIME) -> Column:
    return F.date_format(F.timestamp_millis(ms), pattern)


def today() -> Column:
    """Today as a whole number, yyyyMMdd."""
    return F.date_format(F.current_date(), PARTITION).cast("int")
