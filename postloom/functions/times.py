"""Naive-UTC time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
HOUR_US = 3_600_000_000


def epoch_to_utc(seconds: Column) -> Column:
    """Epoch seconds to a naive UTC timestamp."""
    days = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)")
    return F.expr(EPOCH) + F.make_dt_interval(days, F.lit(0), F.lit(0), rest)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a naive timestamp, as BIGINT."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    clock = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint") * 60
    second = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return days * 86_400_000_000 + clock * 1_000_000 + second


def micros_to_utc(us: Column) -> Column:
    """Inverse of `epoch_micros`."""
    day_us = F.lit(86_400_000_000)
    rest = (F.pmod(us, day_us).cast("decimal(20,6)") / 1_000_000).cast("decimal(18,6)")
    days = F.floor(us.cast("decimal(20,0)") / day_us).cast("int")
    return F.expr(EPOCH) + F.make_dt_interval(days, F.lit(0), F.lit(0), rest)


def aware_to_utc(text: Column) -> Column:
    """ISO time with an offset to a naive UTC timestamp, whatever the session's time zone."""
    return micros_to_utc(F.unix_micros(F.to_timestamp(text)))
