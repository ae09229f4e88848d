"""Stored daily sketches that answer distinct counts and percentiles over any range of days without reading events again.

A state row holds one mergeable sketch per day and key.  A range merges the states of its days: a week of a key is seven rows, whatever its
events.  Months are partitions of the stored table and are replaced as a whole, so a month can be written again after a failure or for
late rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct values up to 2 ** this are counted exactly; beyond, one standard error is about 1 / sqrt(2 ** this): 1.6 %.
LOG_ENTRIES = 12
#: Ranks are exact up to about this many values and off by less than ``RANK_ERROR`` with 99 % confidence beyond.
RANK_ENTRIES = 4096
RANK_ERROR = 0.0015


def _daily(df: DataFrame, keys: list[str], state: Column, ts: str) -> DataFrame:
    return df.groupBy(F.col(ts).cast("date").alias("day"), *keys).agg(state.alias("state"), F.count("*").alias("events"))


def distinct_states(df: DataFrame, keys: list[str], column: str, ts: str = "ts", log_entries: int = LOG_ENTRIES) -> DataFrame:
    """``day``, keys, ``state`` and ``events``: the distinct values of each day, partial states merged before and after one shuffle.

    NULL values are not counted; a day without values has a state of none.
    """
    return _daily(df, keys, F.theta_sketch_agg(column, log_entries), ts)


def quantile_states(df: DataFrame, keys: list[str], column: str, ts: str = "ts", entries: int = RANK_ENTRIES) -> DataFrame:
    """``day``, keys, ``state`` and ``events``: the distribution of a whole-number column per day; NULL values are left out."""
    return _daily(df, keys, F.kll_sketch_agg_bigint(F.col(column).cast("bigint"), entries), ts)


def write_states(states: DataFrame, path: str) -> None:
    """Replace the months that ``states`` holds and leave the others."""
    rows = states.withColumn("month", F.trunc("day", "month")).hint("rebalance", "month")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_states(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """States of the days from ``first`` to ``last``; other months are not read."""
    states = spark.read.parquet(path)
    if first is not None:
        states = states.where((F.col("month") >= F.trunc(F.lit(first).cast("date"), "month")) & (F.col("day") >= F.lit(first).cast("date")))
    if last is not None:
        states = states.where((F.col("month") <= F.lit(last).cast("date")) & (F.col("day") <= F.lit(last).cast("date")))
    return states.drop("month")


def distinct_over(states: DataFrame, keys: list[str], period: Column | None = None, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """Keys, ``distinct_values`` and ``events`` of all given days, or of each ``period`` of days (an expression over ``day``)."""
    by = [*([period.alias("period")] if period is not None else []), *keys]
    merged = states.groupBy(*by).agg(F.theta_union_agg("state", log_entries).alias("state"), F.sum("events").alias("events"))
    return merged.withColumn("distinct_values", F.theta_sketch_estimate("state").cast("bigint")).drop("state")


def rolling_distinct(states: DataFrame, keys: list[str], days: int, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """For every day and key with events: distinct values and events of the trailing ``days`` days.

    A state goes to the windows it is part of, so ``days`` copies of states are merged, not of events.
    """
    ends = states.select("day", *keys)
    copies = states.withColumn("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda n: F.date_add("day", n))))
    return distinct_over(copies.join(ends, ["day", *keys], "left_semi"), keys, F.col("day"), log_entries).withColumnRenamed("period", "day")


def common_values(states: DataFrame, key: str, pairs: DataFrame, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """For each pair of keys (``a``, ``b``) how many values both have, from their merged states: set intersection without events."""
    merged = states.groupBy(key).agg(F.theta_union_agg("state", log_entries).alias("state"))
    left = merged.select(F.col(key).alias("a"), F.col("state").alias("state_a"))
    right = merged.select(F.col(key).alias("b"), F.col("state").alias("state_b"))
    both = F.theta_sketch_estimate(F.theta_intersection("state_a", "state_b")).cast("bigint")
    return pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("common_values"))


def quantiles_over(states: DataFrame, keys: list[str], points: dict[str, float], period: Column | None = None) -> DataFrame:
    """Keys, one column per point and the number of ``values``, over all given days or each ``period`` of days.

    A point p is the smallest value whose rank is at least p of all; groups without values are left out.
    """
    by = [*([period.alias("period")] if period is not None else []), *keys]
    merged = states.groupBy(*by).agg(F.kll_merge_agg_bigint("state").alias("state"))
    sized = merged.withColumn("values", F.kll_sketch_get_n_bigint("state")).where(F.col("values") > 0)
    return sized.withColumns({name: F.kll_sketch_get_quantile_bigint("state", F.lit(float(p))) for name, p in points.items()}).drop("state")
