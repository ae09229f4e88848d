"""Registry of runnable queries: a Spark plan over the provided tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.plans.adapters import oracle

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def plain_times(df: DataFrame) -> DataFrame:
    """Instants and dates shown as wall-clock UTC, as the provided tables store them."""
    timed = (T.TimestampType, T.DateType)
    stamps = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, timed)}
    return df.withColumns(stamps) if stamps else df


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a plan under ``name``; ``sql`` may use the canonical views as ``v_<view>``."""

    def register(fn: Runner) -> Runner:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_times(fn(spark, sf_dir))

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return register
