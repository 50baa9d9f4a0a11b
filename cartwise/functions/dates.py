"""Date parsing and calendar features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted text formats of the invoice date, tried in order
# (the raw file uses month/day/year with a 24h clock).
DATE_FORMATS = ["M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]


def parse_invoice_date(c, dtype=None) -> Column:
    """Text → TIMESTAMP_NTZ; unparsable → NULL; timestamps pass through."""
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and not isinstance(dtype, T.StringType):
        return col.cast("timestamp_ntz")
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS])


def season(ts) -> Column:
    """Month % 12 div 3 + 1 (1 = Dec–Feb)."""
    return F.floor((F.month(ts) % 12) / 3).cast("int") + 1


def day_of_week(ts) -> Column:
    """Monday = 1 … Sunday = 7 (``weekday`` is 0-based from Monday)."""
    return F.weekday(ts) + 1
