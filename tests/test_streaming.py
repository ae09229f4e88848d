"""Streams in several batches against the batch answer; late and repeated rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyledger.operators.correlation import privesc_sequence
from skyledger.operators.detections import RULE_BY_ID, threshold_rule
from skyledger.streaming import jobs
from skyledger.streaming.stages import advance, stage_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, user_name string, host string, action string, outcome string, duration_ms long, src_ip string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def row(i, seconds, action="ListUsers", user="u", outcome="failure"):
    return (i, at(seconds), user, "h", action, outcome, 10, "10.0.0.1")


def write(spark, folder, *batches):
    """One file per batch, in order of arrival."""
    import os
    import time

    for n, rows in enumerate(batches):
        part = str(folder / f"in-{n}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(part)
        now = time.time() - 1000 + n * 10
        for name in os.listdir(part):
            os.utime(os.path.join(part, name), (now, now))
    return str(folder / "in-*")


def run(spark, df, folder):
    query = jobs.run_available(df, str(folder / "out"), str(folder / "cp"))
    return query, spark.read.schema(df.schema).parquet(str(folder / "out"))


def source(spark, path):
    return jobs.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)


def test_tumbling_rule_over_batches_equals_batch(spark, tmp_path):
    rows = [row(i, i * 70) for i in range(60)]
    path = write(spark, tmp_path, rows[:25], rows[25:50], rows[50:])
    runs = lambda df: df.withColumn("dataset", F.lit("aws.mwaa"))
    _, out = run(spark, jobs.detect_stream(runs(source(spark, path)), RULE_BY_ID["D01"]), tmp_path)
    closed = at(59 * 70 - 120)
    batch = threshold_rule(runs(spark.createDataFrame(rows, SCHEMA)), RULE_BY_ID["D01"]).filter(F.col("window_start") + F.expr("INTERVAL 15 MINUTES") <= F.lit(closed))
    pick = lambda df: sorted((r["window_start"], r["hits"]) for r in df.collect())
    assert pick(out) == pick(batch) and pick(out)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    path = write(spark, tmp_path, [row(1, 0), row(2, 4000)], [row(3, 8000)], [row(4, 10), row(5, 8010)])
    counter = jobs.LateRows()
    spark.streams.addListener(counter)
    query, out = run(spark, jobs.bucket_stream(source(spark, path), ["host"]), tmp_path)
    assert counter.of(query) == 1
    spark.streams.removeListener(counter)
    assert [(r["bucket"], r["events"]) for r in out.orderBy("bucket").collect()] == [(at(0), 1), (at(3600), 1)]


def test_repeated_ids_are_kept_once(spark, tmp_path):
    path = write(spark, tmp_path, [row(1, 0), row(1, 0), row(2, 5)], [row(2, 5), row(3, 9)])
    _, out = run(spark, jobs.deduplicated(source(spark, path)), tmp_path)
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3]


def test_rows_reach_the_folder_of_their_stream(spark, tmp_path):
    from skyledger.sources.streams import read_stream

    path = write(spark, tmp_path, [row(1, 0), row(2, 10, user="v")], [row(3, 90000)])
    routed = source(spark, path).select("id", "ts", F.concat(F.lit("logs-aws."), "user_name", F.lit("-default")).alias("target"))
    jobs.run_routed(routed, str(tmp_path / "root"), str(tmp_path / "cp"))
    assert sorted(r["id"] for r in read_stream(spark, str(tmp_path / "root"), "logs-aws.u*").collect()) == [1, 3]


def test_sessions_split_at_the_gap(spark, tmp_path):
    path = write(spark, tmp_path, [row(1, 0), row(2, 100)], [row(3, 150), row(4, 2000)], [row(5, 9000)])
    _, out = run(spark, jobs.attack_sessions(source(spark, path), "user_name", "10 minutes"), tmp_path)
    assert [(r["session_start"], r["events"]) for r in out.orderBy("session_start").collect()] == [(at(0), 3), (at(2000), 1)]


def test_stages_out_of_order_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    chain = ("ListUsers", "CreateAccessKey", "AttachUserPolicy", "AssumeRole")
    rows = [row(i, s, a, u) for i, (s, a, u) in enumerate([
        (0, chain[0], "u"), (20, chain[2], "u"), (10, chain[1], "u"), (30, chain[3], "u"),
        (5, chain[0], "v"), (15, chain[2], "v"), (25, chain[1], "v"), (40, chain[3], "v"), (5000, chain[0], "w"),
    ])]
    path = write(spark, tmp_path, [rows[1], rows[3], rows[4]], [rows[0], rows[2], *rows[5:8]], [rows[8]])
    _, out = run(spark, stage_stream(source(spark, path), "user_name", chain, 3600), tmp_path)
    got = sorted(tuple(r) for r in out.collect())
    want = sorted(tuple(r) for r in privesc_sequence(spark.createDataFrame(rows, SCHEMA)).select("user_name", "t1", "t2", "t3", "t4").collect())
    assert got == want == [("u", at(0), at(10), at(20), at(30))]


def test_many_actors_share_a_key_of_the_tracker(spark, tmp_path):
    """The work outside the rows themselves follows the buckets and spans, not the number of actors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    chain = ("ListUsers", "CreateAccessKey", "AttachUserPolicy", "AssumeRole")
    steps = [(u, s * 40 + u % 7, chain[(s + u) % 4]) for u in range(700) for s in range(7)]
    rows = [row(i, t, a, f"u{u}") for i, (u, t, a) in enumerate(steps)]
    path = write(spark, tmp_path, [r for r in rows if r[1] < at(130)], [r for r in rows if r[1] >= at(130)], [row(99999, 9000, chain[0], "w")])
    query, out = run(spark, stage_stream(source(spark, path), "user_name", chain, 3600), tmp_path)
    got = sorted(tuple(r) for r in out.collect())
    want = sorted(tuple(r) for r in privesc_sequence(spark.createDataFrame(rows, SCHEMA)).select("user_name", "t1", "t2", "t3", "t4").collect())
    assert got == want and len(got) == 700
    timers = [int(op["customMetrics"]["numRegisteredTimers"]) for p in query.recentProgress for op in p["stateOperators"]]
    assert 0 < max(timers) <= 3 * 2 * 256  # a block, what is left of it, the end of the span


@pytest.mark.parametrize(
    ("stage", "at_", "waiting", "done"),
    [
        (0, 5, [[], [[1], [5]], [[1, 3]]], []), (1, 5, [[], [], [[1, 3], [1, 5]]], []), (1, 1, [[], [[1]], [[1, 3]]], []),
        (2, 5, [[], [[1]], []], [[1, 3, 5]]), (2, 3, [[], [[1]], [[1, 3]]], []), (1, 200, [[], [], [[1, 3]]], []),
    ],
)
def test_advance(stage, at_, waiting, done):
    state = [[], [[1]], [[1, 3]]]
    assert advance(state, stage, at_, limit=100) == done and state == waiting


def test_alert_join_keeps_the_latest_minute(spark, tmp_path):
    events, alerts = tmp_path / "e", tmp_path / "a"
    events.mkdir(), alerts.mkdir()
    e = source(spark, write(spark, events, [row(1, 10, user="x"), row(2, 100, user="y"), row(3, 130, user="z")], [row(4, 9000)]))
    a = source(spark, write(spark, alerts, [row(90, 125), row(91, 5)], [row(92, 9000)]))
    _, out = run(spark, jobs.alert_audit_join(a, jobs.minute_sources(e, "host")), tmp_path)
    got = {r["alert_id"]: r["event_user"] for r in jobs.latest_match(out).collect()}
    assert got == {90: "y"}


def test_alert_join_looks_into_the_alerts_minute(spark, tmp_path):
    """Events at :05 and :50 of the minute, alert at :30: the one at :05 counts."""
    events, alerts = tmp_path / "e", tmp_path / "a"
    events.mkdir(), alerts.mkdir()
    e = write(spark, events, [row(1, 3605, user="x"), row(2, 3650, user="y"), row(3, 30, user="old")], [row(4, 90000)])
    a = write(spark, alerts, [row(90, 3630), row(91, 3603)], [row(92, 90000)])
    (tmp_path / "1").mkdir(), (tmp_path / "2").mkdir()
    _, own = run(spark, jobs.alert_minute_join(source(spark, a), source(spark, e)), tmp_path / "1")
    _, earlier = run(spark, jobs.alert_audit_join(source(spark, a), jobs.minute_sources(source(spark, e), "host")), tmp_path / "2")
    got = {r["alert_id"]: r["event_user"] for r in jobs.latest_match(own.unionByName(earlier)).collect()}
    assert got == {90: "x", 91: "old", 92: "u"}


def sorted_before_exchange(df):
    """Whether rows of a leaf are sorted before they are dealt out to tasks."""
    planned, found = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    for n, line in enumerate(planned):
        if "Scan" in line:
            above = planned[: n + 1][::-1]
            chain = above[: next((k for k, x in enumerate(above) if "Exchange" in x), len(above))]
            found.append(any("Sort" in x for x in chain))
    assert found
    return any(found)


def test_latest_match_sorts_no_pairs(spark, tmp_path):
    """Pairs are many times the alerts; ties go to the largest id, then to the largest text, and NULL texts are smallest."""
    events = [(h, at(m * 60), e, f"10.0.0.{e}" if e % 3 else None, f"{h}{e}{x}") for h in ("h", "g") for m in range(20) for e in (m, m + 1) for x in ("", "", "z")]
    alerts = [(i, at(300 + i * 20), h) for i in range(40) for h in ("h", "g") if h == "h" or i % 4 == 0]
    pairs = [(i, t, h, e_ts, *rest) for i, t, h in alerts for host, e_ts, *rest in events if host == h and e_ts <= t]
    schema = "alert_id long, alert_ts timestamp, alert_key string, event_ts timestamp, event_id long, src_ip string, event_user string"
    spark.createDataFrame(pairs, schema).write.parquet(str(tmp_path / "pairs"))
    out = jobs.latest_match(spark.read.schema(schema).parquet(str(tmp_path / "pairs")))
    want = {}
    for i, _, _, e_ts, e, ip, user in pairs:
        want[i] = max(want.get(i, (at(-1), 0, "", "")), (e_ts, e, ip or "", user))
    got = {r["alert_id"]: (r["event_ts"], r["src_ip"] or "", r["event_user"]) for r in out.collect()}
    assert got == {i: (w[0], *w[2:]) for i, w in want.items()} and out.count() == 40
    assert not sorted_before_exchange(out)


def test_minutes_are_dealt_out_before_they_are_sorted(spark, tmp_path):
    spark.createDataFrame([row(i, i * 7, user=f"u{i % 3}") for i in range(200)], SCHEMA).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    for key in ("host", "user_name", "src_ip"):
        minutes = jobs.minute_sources(events, key)
        assert minutes.count() == events.select(key, F.date_trunc("minute", "ts")).distinct().count()
        assert not sorted_before_exchange(minutes)


def test_late_rows_of_many_batches_are_all_counted(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        path = write(spark, tmp_path, [row(0, 90000)], *[[row(i, i)] for i in range(1, 8)])
        counter = jobs.LateRows()
        spark.streams.addListener(counter)
        query, out = run(spark, jobs.bucket_stream(source(spark, path), ["host"]), tmp_path)
        on_time = sum(r["events"] for r in out.collect())  # files of one instant may come before the one that moves the watermark
        assert counter.of(query) + on_time == 7 and counter.of(query) > 3
    finally:
        spark.streams.removeListener(counter)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
