"""Instants: ISO text with mixed offsets and separators, months and epoch cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"([zZ]|[+-][0-9]{2}(:?[0-9]{2})?)$"
_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?\s*([zZ]|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"


def iso_instant(text: Column) -> Column:
    """The UTC instant of ISO text; no offset means UTC; null, blank or unreadable text gives null."""
    t = F.trim(text)
    whole = F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00Z"))).when(F.substring(t, 11, 30).rlike(_OFFSET), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(_SHAPE), F.regexp_replace(whole, ",", ".").try_cast("timestamp"))


def utc_month(instant: Column) -> Column:
    """``YYYY-MM`` in UTC whatever the session's time zone; null stays null."""
    days = F.floor(F.unix_micros(instant) / F.lit(86_400_000_000))
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM")
