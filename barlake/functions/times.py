"""Time expressions on epoch milliseconds; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MILLIS_PER_DAY = 86_400_000


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def millis_now() -> Column:
    """The clock as epoch milliseconds, one value per query or micro-batch."""
    return F.unix_millis(F.current_timestamp())


def instant_of_millis(millis: Column | str) -> Column:
    return F.timestamp_millis(_column(millis))


def day_of_millis(millis: Column | str) -> Column:
    """UTC calendar day, also right for times before 1970."""
    millis = _column(millis)
    start_of_day = millis - F.pmod(millis, F.lit(MILLIS_PER_DAY))
    return F.date_from_unix_date((start_of_day / MILLIS_PER_DAY).cast("int"))


def utc_date_text(millis: Column | str) -> Column:
    """UTC calendar day as yyyy-MM-dd text."""
    return day_of_millis(millis).cast("string")


def nanos_of_millis(millis: Column | str) -> Column:
    return _column(millis) * F.lit(1_000_000).cast("bigint")
