"""Chunked ordered look-ups against brute force, for hot keys, chunk borders and any partitioning."""

import datetime as dt
import random

import pytest

from skyledger.functions import ordered as o

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    key = lambda: "hot" if rng.random() < 0.6 else rng.choice("abc")
    events = [(i, key(), at(rng.randrange(0, 40000)), rng.randrange(1, 100)) for i in range(400)]
    probes = [(1000 + i, key(), at(rng.randrange(0, 40000))) for i in range(150)] + [(5000, None, at(10))]
    return events, probes


@pytest.fixture(scope="module", params=[1, 37])
def frames(spark, data, request):
    events, probes = data
    e = spark.createDataFrame(events, "eid int, key string, ts timestamp, v long").repartition(request.param)
    p = spark.createDataFrame(probes, "id int, key string, ts timestamp").repartition(request.param)
    return e, p


@pytest.mark.parametrize("chunk", [60, 3600, 10**6])
def test_asof_latest(frames, data, chunk):
    e, p = frames
    events, probes = data
    got = {r["id"]: (r["src_ts"], r["src_v"]) for r in o.asof_latest(p, e, ["key"], ["v"], "eid", 1800, chunk_seconds=chunk).collect()}
    for pid, key, ts in probes:
        hits = [(t, i, v) for i, k, t, v in events if k == key and ts - dt.timedelta(seconds=1800) <= t <= ts]
        best = max(hits) if hits else None
        assert got[pid] == ((best[0], best[2]) if best else (None, None))


@pytest.mark.parametrize("chunk", [60, 3600])
def test_interval_total_and_counts(frames, data, chunk):
    e, p = frames
    events, probes = data
    from pyspark.sql import functions as F

    out = o.interval_total(p, e, ["key"], 900, "total", after=300, value=F.col("v"), chunk_seconds=chunk)
    got = {r["id"]: r["total"] for r in out.collect()}
    for pid, key, ts in probes:
        want = sum(v for _, k, t, v in events if k == key and ts - dt.timedelta(seconds=900) <= t <= ts + dt.timedelta(seconds=300))
        assert got[pid] == want
    glob = {r["id"]: r["n"] for r in o.trailing_count(p, e, [], 600, "n", chunk_seconds=chunk).collect()}
    for pid, _, ts in probes:
        assert glob[pid] == sum(1 for _, _, t, _ in events if ts - dt.timedelta(seconds=600) <= t <= ts)


@pytest.mark.parametrize("chunk", [60, 7200])
def test_previous_and_numbered(frames, data, chunk):
    e, _ = frames
    events, _ = data
    prev = {r["eid"]: r["prev_v"] for r in o.with_previous(e, ["key"], "ts", ["v"], ["eid"], chunk).collect()}
    num = {r["eid"]: r["n"] for r in o.numbered(e, ["key"], "ts", ["eid"], "n", chunk).collect()}
    for key in {k for _, k, _, _ in events}:
        ordered = sorted((t, i, v) for i, k, t, v in events if k == key)
        for pos, (_, i, _) in enumerate(ordered):
            assert num[i] == pos + 1
            assert prev[i] == (ordered[pos - 1][2] if pos else None)


@pytest.mark.parametrize("bits", [(20, 16), (24, 2), (34, 3), (40, 1)])
def test_previous_rows(frames, data, bits, monkeypatch):
    e, _ = frames
    events, _ = data
    monkeypatch.setattr(o, "_SECOND_BITS", bits[0])
    monkeypatch.setattr(o, "_CHUNK_BITS", bits[1])
    got = {r["eid"]: [x["eid"] for x in r["near"]] for r in o.previous_rows(e, ["key"], "ts", "eid", ["v"], 3, 5000, "near").collect()}
    for i, key, ts, _ in events:
        before = sorted([(t, j) for j, k, t, _ in events if k == key and (t, j) < (ts, i) and t >= ts - dt.timedelta(seconds=5000)], reverse=True)
        assert got[i] == [j for _, j in before[:3]]


def test_exact_percentiles(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else "x", rng.randrange(0, 5000)) for _ in range(700)]
    df = spark.createDataFrame(rows, "k string, v long")
    import numpy as np

    for width in (None, 1, 50, 10**6):
        got = {r["k"]: r for r in o.exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}, width).collect()}
        for k in ("hot", "x"):
            v = [b for a, b in rows if a == k]
            assert got[k]["throughput"] == len(v)
            assert got[k]["p50"] == pytest.approx(np.percentile(v, 50)) and got[k]["p99"] == pytest.approx(np.percentile(v, 99))


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "eid int, key string, ts timestamp, v long")
    p = spark.createDataFrame([(1, "a", at(0))], "id int, key string, ts timestamp")
    assert o.asof_latest(p, e, ["key"], ["v"], "eid", 60).first()["src_v"] is None
    assert o.trailing_count(p, e, ["key"], 60, "n").first()["n"] == 0
    assert o.numbered(e, ["key"], "ts", ["eid"], "n").count() == 0


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from skyledger.functions.joins import checked_broadcast

    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    small, wide = spark.range(50), spark.range(50).select("id", F.repeat(F.lit("x"), 10_000).alias("t"))
    assert hinted(checked_broadcast(small)) and not hinted(checked_broadcast(small, max_rows=49))
    assert hinted(checked_broadcast(wide)) and not hinted(checked_broadcast(wide, max_bytes=400_000))
    assert hinted(checked_broadcast(small.limit(0)))
