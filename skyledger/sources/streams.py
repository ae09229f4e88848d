"""Reading data streams: folders by signal, dataset and date, addressed by stream patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.columns import any_of, wildcard

SIGNALS = ("logs", "metrics", "traces")


def split_pattern(pattern: str) -> tuple[str, str, str]:
    """``logs-aws.vpc*-default`` as signal, dataset pattern and namespace pattern; no namespace means any."""
    signal, _, rest = pattern.partition("-")
    if signal not in SIGNALS or not rest:
        raise ValueError(f"not a stream pattern: {pattern}")
    dataset, dash, namespace = rest.rpartition("-")
    return (signal, dataset, namespace) if dash else (signal, rest, "*")


def _matches(patterns: list[tuple[str, str]]) -> Column:
    return any_of([
        wildcard("dataset", d) if ns == "*" else wildcard("dataset", d) & wildcard("namespace", ns) for d, ns in patterns
    ])


def read_stream(spark: SparkSession, root: str, *patterns: str) -> DataFrame:
    """Rows of the streams of one signal that match any pattern; the dataset filter prunes partitions."""
    parts = [split_pattern(p) for p in patterns]
    if len({s for s, _, _ in parts}) != 1:
        raise ValueError("one signal at a time; use read_streams")
    df = spark.read.option("basePath", root).parquet(f"{root}/signal={parts[0][0]}")
    return df.filter(_matches([(d, ns) for _, d, ns in parts]))


def read_streams(spark: SparkSession, root: str, *patterns: str) -> DataFrame:
    """Rows of several streams, also across signals; columns a signal lacks are NULL."""
    by_signal: dict[str, list[str]] = {}
    for p in patterns:
        by_signal.setdefault(split_pattern(p)[0], []).append(p)
    frames = [read_stream(spark, root, *ps) for ps in by_signal.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_raw_json(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Newline JSON as ``raw`` text and ``doc`` text values by top-level key; ``doc`` is NULL for a broken line."""
    lines = spark.readStream.text(path) if streaming else spark.read.text(path)
    return lines.select(F.col("value").alias("raw"), F.from_json("value", "map<string,string>").alias("doc"))
