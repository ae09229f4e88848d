"""Time windows: look-back filters, fixed buckets and the automatic bucket ladder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import as_col

# Candidate bucket widths in seconds (1,5,10,30 s; 1,5,10,30 m; 1,3,12 h; 1,7,30 d).
BUCKET_LADDER = (1, 5, 10, 30, 60, 300, 600, 1800, 3600, 10800, 43200, 86400, 604800, 2592000)


def auto_interval(start: dt.datetime, end: dt.datetime, target: int = 75) -> int:
    """Smallest ladder width that cuts [start, end] into at most ``target`` buckets, in seconds."""
    span = max((end - start).total_seconds(), 0)
    for width in BUCKET_LADDER:
        if span <= width * target:
            return width
    return BUCKET_LADDER[-1]


def time_range(df: DataFrame, ts: str = "ts") -> tuple[dt.datetime, dt.datetime]:
    """Smallest and largest timestamp: one row reaches the driver."""
    row = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    return row["lo"], row["hi"]


def bucket(ts: str | Column, width: int | str) -> Column:
    """Start of the tumbling window (seconds or an interval text) that holds ``ts``."""
    duration = f"{width} seconds" if isinstance(width, int) else width
    return F.window(as_col(ts), duration).getField("start")


def lookback(df: DataFrame, as_of: str | dt.datetime, interval: str, ts: str = "ts", date_col: str | None = None) -> DataFrame:
    """Rows of the trailing interval up to ``as_of``; with ``date_col`` the date partitions are pruned as well."""
    now = F.lit(as_of).cast("timestamp")
    since = now - F.expr(f"INTERVAL {interval}")
    kept = df.filter((as_col(ts) >= since) & (as_col(ts) <= now))
    if date_col:
        kept = kept.filter((as_col(date_col) >= since.cast("date")) & (as_col(date_col) <= now.cast("date")))
    return kept


def micros(ts: str | Column) -> Column:
    return F.unix_micros(as_col(ts).cast("timestamp"))
