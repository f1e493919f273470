"""Timestamps: coercion from text, and differences in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ISO forms, date alone or with a time; "T" or a space between, seconds, fraction and
# offset optional. Naive text means UTC.
ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(?:([Zz])|([+-])(\d{2})(?::?(\d{2}))?)?)?$"


def coerce_ts(text: Column) -> Column:
    """Blank or unreadable text is NULL. The session zone is expected to be UTC."""
    clean = F.trim(text)
    part = lambda i: F.regexp_extract(clean, ISO, i)
    filled = lambda i, blank: F.when(part(i) == "", blank).otherwise(part(i))
    whole = F.try_to_timestamp(F.concat(part(1), F.lit(" "), filled(2, "00:00"), F.lit(":"), filled(3, "00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    micros = F.rpad(F.substring(part(4), 1, 6), 6, "0").cast("bigint")
    minutes = filled(7, "0").cast("bigint") * 60 + filled(8, "0").cast("bigint")
    offset = F.when(part(6) == "-", -minutes).otherwise(minutes)
    return F.when(clean.rlike(ISO), F.timestamp_micros(F.unix_micros(whole) + micros - offset * 60_000_000))


def delta_ms(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0), 2)


def plus_seconds(at: Column, seconds: int | float) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + F.lit(int(seconds * 1_000_000)))
