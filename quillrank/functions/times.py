"""Times are epoch milliseconds. Strings are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 24 * 60 * 60 * 1000
GITHUB_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
GERRIT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def months_ms(months: int) -> int:
    """Months of 30 days."""
    return months * 30 * DAY_MS


def github_millis(text: Column) -> Column:
    """Null where the text isn't such a time."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(GITHUB_FORMAT)))


def gerrit_millis(text: Column) -> Column:
    """Fractions of a second, if any, don't count. Null where the text isn't such a time."""
    return F.unix_millis(F.try_to_timestamp(F.substring(text, 1, 19), F.lit(GERRIT_FORMAT)))


def column_millis(timestamp: Column) -> Column:
    return F.unix_millis(timestamp.cast("timestamp"))
