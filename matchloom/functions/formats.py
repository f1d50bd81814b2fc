"""Values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_text(share: Column) -> Column:
    """0.456 as ``45.6%``."""
    return F.format_string("%.1f%%", share.cast("double") * 100)


def labelled_percent(name: str, share: Column) -> Column:
    return F.concat(F.lit(f"{name.capitalize()}: "), percent_text(share))


def joined(values: Column) -> Column:
    return F.array_join(values, ", ")


def iso_text(ts: Column) -> Column:
    """ISO text; the fraction is left out when it is zero."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(full, r"\.000000$", "")


def iso_time(text: Column) -> Column:
    """Timestamp of an ISO text; NULL when it is not one."""
    return F.try_to_timestamp(text)


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
