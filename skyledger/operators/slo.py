"""Service-level indicators, rolling objectives and error budgets.

Events are first rolled up to days; the rolling window then runs over one row per day and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Objective targets and the rolling window.
AVAILABILITY_TARGET = 0.995
DATABASE_TARGET = 0.99
WINDOW_DAYS = 30


def _counts(good: Column, total: Column | None) -> dict[str, Column]:
    whole = F.lit(True) if total is None else total
    return {"good": F.count_if(good & whole), "total": F.count_if(whole)}


def sli(df: DataFrame, good: Column, total: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Good over total events; NULL without events."""
    counts = _counts(good, total)
    out = df.groupBy(*(keys or [])).agg(*[v.alias(k) for k, v in counts.items()])
    return out.withColumn("sli", F.try_divide(F.col("good"), F.col("total")))


def slo_rolling(
    df: DataFrame, good: Column, target: float, total: Column | None = None, keys: list[str] | None = None, days: int = WINDOW_DAYS, ts: str = "ts"
) -> DataFrame:
    """Daily rolling indicator over the trailing days, whether it meets the target, and the error budget left."""
    names = keys or []
    counts = _counts(good, total)
    daily = df.groupBy(*names, F.col(ts).cast("date").alias("day")).agg(*[v.alias(f"d_{k}") for k, v in counts.items()])
    part = daily if names else daily.withColumn("__all", F.lit(1))
    w = Window.partitionBy(*(names or ["__all"])).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    rolled = part.withColumns({"good": F.sum("d_good").over(w), "total": F.sum("d_total").over(w)})
    rolled = rolled.withColumn("sli", F.try_divide(F.col("good"), F.col("total")))
    return error_budget(rolled.select(*names, "day", "good", "total", "sli"), target)


def error_budget(slis: DataFrame, target: float) -> DataFrame:
    """Budget used so far (1 means spent), budget left and whether the objective holds."""
    used = (1 - F.col("sli")) / F.lit(1 - target)
    return slis.withColumns({"burn": F.round(used, 6), "budget_left": F.round(1 - used, 6), "met": F.col("sli") >= target})


def database_slo(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The objective of data services: database events only."""
    return slo_rolling(df, F.col("outcome") == "success", DATABASE_TARGET, total=F.col("category") == "database", keys=keys)
