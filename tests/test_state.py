"""Stream state processors in several batches against plain answers, and sliding windows from panes."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators.anomalies import score
from skyledger.operators.correlation import ordered_sequence
from skyledger.operators.dashboards import PRIVESC_ACTIONS
from skyledger.operators.detections import Rule, threshold_rule
from skyledger.streaming import jobs, state

from test_streaming import SCHEMA, at, row, run, source, write


def batches_of(rows, n):
    """Roughly in time order, mixed inside the delay."""
    rng = random.Random(4)
    ordered = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(0, 100)))
    size = -(-len(ordered) // n)
    return [ordered[i : i + size] for i in range(0, len(ordered), size)]


def test_latest_event_per_alert(spark, tmp_path):
    rng = random.Random(9)
    place = lambda: rng.choice(["hot", "hot", "hot", "x", None])
    events = [(i, at(rng.randrange(0, 9000)), f"u{i}", place(), "ListUsers", "failure", 1, "10.0.0.1") for i in range(300)]
    alerts = [(1000 + i, at(rng.randrange(0, 9000)), "a", place(), "x", "failure", 1, "10.0.0.2") for i in range(80)]
    week = 7 * 86400 - (dt.datetime(2024, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds() % (7 * 86400)  # a border of the state's spans
    events += [(900, at(week - 30), "late", "x", "ListUsers", "failure", 1, "10.0.0.1"), (901, at(week + 9000), "end", "x", "ListUsers", "failure", 1, "10.0.0.1")]
    alerts += [(1900, at(week + 20), "a", "x", "x", "failure", 1, "10.0.0.2"), (1901, at(week + 9000), "a", "x", "x", "failure", 1, "10.0.0.2")]
    (tmp_path / "e").mkdir(), (tmp_path / "a").mkdir()
    e = source(spark, write(spark, tmp_path / "e", *batches_of(events, 4)))
    a = source(spark, write(spark, tmp_path / "a", *batches_of(alerts, 4)))
    _, out = run(spark, state.alerts_with_latest_event(a, e), tmp_path)
    got = {r["alert_id"]: (r["event_ts"], r["event_id"]) for r in out.collect()}
    assert len(got) == out.count()
    closed = at(week + 9000 - 120)
    expected = {}
    for i, t, _, host, *_ in alerts:
        if t <= closed:
            hit = max(((x[1], x[0]) for x in events if host is not None and x[3] == host and t - dt.timedelta(hours=1) <= x[1] <= t), default=(None, None))
            expected[i] = hit
    assert got == expected and any(x[0] for x in got.values()) and any(not x[0] for x in got.values())


def newest_per_end(rows):
    best = {}
    for r in rows:
        key = (r["user_name"], r["t4"])
        if key not in best or r["t1"] > best[key]["t1"]:
            best[key] = r
    return sorted(tuple(r) for r in best.values())


def test_newest_chains_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [row(i, rng.randrange(0, 6000), rng.choice(PRIVESC_ACTIONS + ("Other",)), rng.choice(["u", "v"])) for i in range(300)]
    rows.append(row(999, 30000, "ListUsers", "w"))
    _, out = run(spark, state.newest_chains(source(spark, write(spark, tmp_path, *batches_of(rows, 5))), "user_name", PRIVESC_ACTIONS, 600), tmp_path)
    batch = ordered_sequence(spark.createDataFrame(rows, SCHEMA), "user_name", PRIVESC_ACTIONS, 600).select("user_name", "t1", "t2", "t3", "t4")
    got = sorted(tuple(r) for r in out.collect())
    assert got == newest_per_end(batch.collect()) and len(got) > 5


def test_a_million_events_leave_three_chains():
    rng = np.random.default_rng(1)
    us, stage = np.sort(rng.integers(0, 3_600_000_000, 1_000_000)), rng.integers(0, 3, 1_000_000)
    chains = [[], [], [], []]
    assert state.advance_newest(chains, us, stage, 10**15) == []
    assert sum(map(len, chains)) <= 6
    (done,) = state.advance_newest(chains, np.array([3_600_000_001]), np.array([3]), 10**15)
    assert done == sorted(done) and len(set(done)) == 4


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_chains_do_not_depend_on_batches(parts):
    rng = np.random.default_rng(5)
    us, stage = np.sort(rng.integers(0, 400, 600)), rng.integers(0, 4, 600)
    whole = state.advance_newest([[], [], [], []], us, stage, 50)
    chains, out = [[], [], [], []], []
    cuts = np.searchsorted(us, np.linspace(0, 401, parts + 1))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out += state.advance_newest(chains, us[a:b], stage[a:b], 50)
    assert out == whole and len(whole) > 10


def test_buckets_are_scored_as_they_close(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, at(b * 900 + rng.randrange(0, 900)), "u", h, "a", "failure", None if b % 11 == 3 else rng.randrange(1, 50) * (40 if b % 17 == 9 else 1), "10.0.0.1") for h in ("h1", "h2") for b in range(60) if h == "h1" or b % 3 for i in range(3)]
    closed = jobs.bucket_stream(source(spark, write(spark, tmp_path, *batches_of(rows, 6))), ["host"]).withColumn("mean_ms", F.col("total_ms") / F.col("events"))
    _, out = run(spark, state.score_closed_buckets(closed, ["host"], "mean_ms"), tmp_path)
    series = jobs.per_bucket(spark.createDataFrame(rows, SCHEMA), ["host"], "15 minutes").withColumn("mean_ms", F.col("total_ms") / F.col("events"))
    last = max(r[1] for r in rows) - dt.timedelta(seconds=120)
    batch = score(series.where(F.col("bucket") + F.expr("INTERVAL 15 MINUTES") <= F.lit(last)), "mean_ms", ["host"])
    pick = lambda df: sorted((r["bucket"], r["host"], round(r["actual"], 6), round(r["anomaly_score"], 2)) for r in df.collect())
    assert pick(out) == pick(batch) and len(pick(out)) > 3


@pytest.mark.parametrize("approx", [False, True])
@pytest.mark.parametrize(("window", "slide"), [("15 minutes", "5 minutes"), ("15 minutes", "10 minutes"), ("1 hour", "1 hour")])
def test_panes_equal_copies(spark, approx, window, slide):
    rng = random.Random(6)
    rows = [row(i, rng.randrange(0, 20000), f"a{rng.randrange(9)}", rng.choice("uvw")) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    rule = Rule("X", "x", "action <> 'a0'", keys=("user_name",), min_count=3, distinct="action", min_distinct=2)
    got = sorted((r["window_start"], r["user_name"], r["hits"], r["distinct_values"]) for r in threshold_rule(df, rule, window, slide, approx).collect())
    copied = df.where("action <> 'a0'").groupBy(F.window("ts", window, slide).alias("w"), "user_name").agg(F.count("*").alias("n"), F.count_distinct("action").alias("d"))
    assert got == sorted((r["w"]["start"], r["user_name"], r["n"], r["d"]) for r in copied.where("n >= 3 AND d >= 2").collect())


def test_rows_are_not_copied_per_window(spark):
    """Whatever the ratio of width and slide, a row leaves the first aggregate as part of one pane."""
    df = spark.createDataFrame([row(i, i) for i in range(300)], SCHEMA)
    plan = threshold_rule(df, Rule("X", "x", "TRUE", keys=("host",)), "1 hour", "1 minute")._jdf.queryExecution().optimizedPlan().toString()
    copies = max(plan.rfind("Expand"), plan.rfind("Generate"))
    assert 0 <= plan.index("Aggregate") < copies < plan.rindex("Aggregate")


def test_paned_rule_on_a_stream(spark, tmp_path):
    rows = [row(i, i * 40, f"a{i % 7}") for i in range(120)]
    rule = Rule("X", "x", "TRUE", keys=("host",), min_count=5, distinct="action", min_distinct=3)
    _, out = run(spark, jobs.detect_stream(source(spark, write(spark, tmp_path, rows[:50], rows[50:90], rows[90:])), rule, "15 minutes", "5 minutes"), tmp_path)
    last = at(119 * 40 - 120)
    batch = threshold_rule(spark.createDataFrame(rows, SCHEMA), rule, "15 minutes", "5 minutes").where(F.col("window_start") + F.expr("INTERVAL 15 MINUTES") <= F.lit(last))
    pick = lambda df: sorted((r["window_start"], r["host"], r["hits"], r["distinct_values"]) for r in df.collect())
    assert pick(out) == pick(batch) and pick(out)
