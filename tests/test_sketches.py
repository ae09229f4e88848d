"""Stored sketches: exact while small, inside their error bounds beyond, and replaced by month."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import sketches as s

DAY0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    n = 300_000
    day = (F.col("id") % 40).cast("int")
    return spark.range(n).select(
        F.timestamp_add("DAY", day, F.lit(DAY0)).alias("ts"), F.when(F.col("id") % 3 == 0, "x").otherwise("hot").alias("k"),
        F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(60_000))).alias("v"),
    )


def test_distinct_values_of_a_range(spark, events, tmp_path):
    s.write_states(s.distinct_states(events, ["k"], "v"), str(tmp_path / "t"))
    states = s.read_states(spark, str(tmp_path / "t"), "2024-01-05", "2024-02-03")
    got = {r["k"]: r for r in s.distinct_over(states, ["k"]).collect()}
    exact = events.where("ts >= '2024-01-05' AND ts < '2024-02-04'").groupBy("k").agg(F.count_distinct("v").alias("d"), F.count("*").alias("n")).collect()
    for r in exact:
        assert got[r["k"]]["events"] == r["n"] and r["d"] > 30_000
        assert abs(got[r["k"]]["distinct_values"] - r["d"]) <= 3 * r["d"] / np.sqrt(2**s.LOG_ENTRIES)


def test_small_sets_are_exact_and_rolled(spark):
    rows = [(DAY0 + dt.timedelta(days=d, hours=h), k, f"{k}{(d * 7 + h) % 23}") for d in (0, 1, 2, 5, 9) for h in range(12) for k in "ab"] + [(DAY0, "c", None)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v string")
    states = s.distinct_states(df, ["k"], "v")
    got = {(r["k"], r["day"]): (r["distinct_values"], r["events"]) for r in s.rolling_distinct(states, ["k"], 3).collect()}
    days = {(k, t.date()) for t, k, _ in rows}
    for k, day in days:
        near = [v for t, key, v in rows if key == k and 0 <= (day - t.date()).days < 3]
        assert got.pop((k, day)) == (len({v for v in near if v is not None}), len(near))
    assert not got
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "a string, b string")
    assert sorted(tuple(r) for r in s.common_values(states, "k", pairs).collect()) == [("a", "a", 23), ("a", "b", 0)]


def test_quantiles_within_their_rank_error(spark, events):
    points = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r["k"]: r for r in s.quantiles_over(s.quantile_states(events, ["k"], "v"), ["k"], points).collect()}
    for k in ("x", "hot"):
        values = np.sort(np.array([r["v"] for r in events.where(F.col("k") == k).where("v IS NOT NULL").select("v").collect()]))
        assert got[k]["values"] == len(values)
        for name, p in points.items():
            low, high = np.searchsorted(values, got[k][name], "left") / len(values), np.searchsorted(values, got[k][name], "right") / len(values)
            assert low - s.RANK_ERROR <= p <= high + s.RANK_ERROR
    assert s.quantiles_over(s.quantile_states(events.limit(0), ["k"], "v"), ["k"], points).count() == 0


def test_months_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame([(DAY0 + dt.timedelta(days=d), "k", v) for d, v in rows], "ts timestamp, k string, v int")
    s.write_states(s.distinct_states(df((0, 1), (1, 2), (40, 3)), ["k"], "v"), path)
    s.write_states(s.distinct_states(df((0, 1), (1, 2), (2, 9)), ["k"], "v"), path)
    assert sorted((r["day"].day, r["events"]) for r in s.read_states(spark, path).collect()) == [(1, 1), (2, 1), (3, 1), (10, 1)]
    plan = s.read_states(spark, path, "2024-02-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
