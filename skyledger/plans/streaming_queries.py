"""Registered streaming jobs: the provided events run as a stream to the end, their results read back.

Append mode writes what the watermark has passed, so the oracles stop at the last event minus the delay.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators.dashboards import PRIVESC_ACTIONS
from skyledger.operators.detections import RULE_BY_ID
from skyledger.plans.adapters import table, view, view_over
from skyledger.plans.dashboard_queries import tb
from skyledger.plans.normalize_queries import raw_columns
from skyledger.plans.registry import query
from skyledger.session import scratch_path
from skyledger.streaming import jobs, state
from skyledger.streaming.stages import stage_stream


def stream_of(spark, sf, name):
    """A canonical view over the events table read as a stream; the pattern fits one file as well as a folder of files."""
    schema = table(spark, sf, "events").schema
    return view_over(name, events=jobs.file_stream(spark, f"{sf}/events.parque[t]", schema))


def finished(spark, df):
    """Run a stream to its end and read what it wrote."""
    path = scratch_path(spark, "stream")
    jobs.run_available(df, path, scratch_path(spark, "state"))
    return spark.read.schema(df.schema).parquet(path)


CLOSED = "(SELECT max(ts) - INTERVAL '120 seconds' FROM v_logs)"


@query("r01_normalise_stream", "SELECT id, coalesce(pre_kind, 'event') AS kind, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS type, message AS original FROM v_raw_logs")
def _(spark, sf):
    df = jobs.normalise_stream(raw_columns(stream_of(spark, sf, "raw_logs")))
    return finished(spark, df.select("id", F.col("event.kind").alias("kind"), F.array_join("event.type", ",").alias("type"), F.col("event.original").alias("original")))


FAILED_RUNS = "event_type = 'error' AND stream IN ('aws.mwaa', 'gcp.composer', 'azure.datafactory')"


def rule_stream(spark, sf):
    rows = stream_of(spark, sf, "rule_logs")
    return rows.withColumn("dataset", F.col("stream")).drop("stream")


@query("r02_tumbling_detection", f"""SELECT window_start, hits, 'D01' AS rule_id FROM (SELECT {tb('1 day')} AS window_start, count(*) AS hits FROM v_rule_logs
  WHERE {FAILED_RUNS} GROUP BY 1 HAVING count(*) >= 4) WHERE window_start + INTERVAL '1 day' <= {CLOSED}""")
def _(spark, sf):
    return finished(spark, jobs.detect_stream(rule_stream(spark, sf), RULE_BY_ID["D01"], window="1 day")).select("window_start", "hits", "rule_id")


@query("r03_sliding_detection", f"""WITH s AS (SELECT unnest([0, 8, 16]) AS back),
  w AS (SELECT time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01') - to_hours(back) AS window_start FROM v_rule_logs, s WHERE {FAILED_RUNS})
  SELECT window_start, count(*) AS hits FROM w GROUP BY 1 HAVING count(*) >= 4 AND window_start + INTERVAL '1 day' <= {CLOSED}""")
def _(spark, sf):
    return finished(spark, jobs.detect_stream(rule_stream(spark, sf), RULE_BY_ID["D01"], window="1 day", slide="8 hours")).select("window_start", "hits")


@query("r04_late_data", f"SELECT {tb('1 hour')} AS bucket, dataset, count(*) AS events FROM v_logs GROUP BY 1, 2 HAVING bucket + INTERVAL '1 hour' <= {CLOSED}")
def _(spark, sf):
    return finished(spark, jobs.bucket_stream(stream_of(spark, sf, "logs"), ["dataset"], "1 hour")).select("bucket", "dataset", "events")


@query("r05_anomaly_buckets", f"""WITH b AS (SELECT host, {tb('1 hour')} AS bucket, sum(duration_ms) / CAST(count(*) AS DOUBLE) AS x FROM v_logs GROUP BY 1, 2 HAVING bucket + INTERVAL '1 hour' <= {CLOSED}),
  m AS (SELECT *, avg(x) OVER w AS mean, stddev_samp(x) OVER w AS sd, count(x) OVER w AS seen FROM b WINDOW w AS (PARTITION BY host ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
  z AS (SELECT *, round(100 * (1 - exp(-greatest((x - mean) / greatest(sd, 1e-9) - 2, 0) / 3)), 3) AS anomaly_score FROM m WHERE seen >= 8)
  SELECT bucket, host, x AS actual, anomaly_score FROM z WHERE anomaly_score > 0""")
def _(spark, sf):
    """Each bucket is scored in the stream as it closes."""
    closed = jobs.bucket_stream(stream_of(spark, sf, "logs"), ["host"], "1 hour").withColumn("mean_ms", F.col("total_ms") / F.col("events"))
    return finished(spark, state.score_closed_buckets(closed, ["host"], "mean_ms"))


@query("r06_attack_sessions", f"""WITH g AS (SELECT user_name, ts, action, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_name ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM v_logs),
  n AS (SELECT *, sum(new) OVER (PARTITION BY user_name ORDER BY ts) AS s FROM g)
  SELECT user_name, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS events, count(DISTINCT action) AS actions, max(ts) AS last_event
  FROM n GROUP BY user_name, s HAVING max(ts) + INTERVAL '2 hours' <= {CLOSED}""")
def _(spark, sf):
    return finished(spark, jobs.attack_sessions(stream_of(spark, sf, "logs"), "user_name", "2 hours"))


CHAINS_CTE = f"""WITH a AS (SELECT user_name, ts AS t1 FROM v_logs WHERE action = 'ListUsers'),
  b AS (SELECT a.*, (SELECT min(l.ts) FROM v_logs l WHERE l.user_name = a.user_name AND l.action = 'CreateAccessKey' AND l.ts > a.t1) AS t2 FROM a),
  c AS (SELECT b.*, (SELECT min(l.ts) FROM v_logs l WHERE l.user_name = b.user_name AND l.action = 'AttachUserPolicy' AND l.ts > b.t2) AS t3 FROM b),
  d AS (SELECT c.*, (SELECT min(l.ts) FROM v_logs l WHERE l.user_name = c.user_name AND l.action = 'AssumeRole' AND l.ts > c.t3) AS t4 FROM c),
  done AS (SELECT * FROM d WHERE t4 <= t1 + INTERVAL '3 days' AND t4 <= date_trunc('milliseconds', {CLOSED}))"""


@query("r07_stage_tracker", CHAINS_CTE + " SELECT * FROM done")
def _(spark, sf):
    state.use_rocksdb(spark)
    return finished(spark, stage_stream(stream_of(spark, sf, "logs"), "user_name", PRIVESC_ACTIONS, 3 * 86400))


@query("r07_newest_chains", CHAINS_CTE + " SELECT user_name, max(t1) AS t1, arg_max(t2, t1) AS t2, arg_max(t3, t1) AS t3, t4 FROM done GROUP BY user_name, t4")
def _(spark, sf):
    """The tightest form of each completed chain, from one open chain a stage and user."""
    return finished(spark, state.newest_chains(stream_of(spark, sf, "logs"), "user_name", PRIVESC_ACTIONS, 3 * 86400))


@query("r08_alert_audit_join", """WITH e AS (SELECT * FROM v_logs WHERE action IN ('ListUsers', 'CreateAccessKey', 'AttachUserPolicy', 'AssumeRole')),
  closed AS (SELECT least((SELECT max(ts) FROM e), (SELECT max(ts) FROM v_alerts)) - INTERVAL '120 seconds' AS t),
  p AS (SELECT a.id, e.ts, e.src_ip, e.user_name, row_number() OVER (PARTITION BY a.id ORDER BY e.ts DESC, e.id DESC) AS rn FROM v_alerts a
    JOIN e ON e.host = a.host AND e.ts <= a.ts AND e.ts >= a.ts - INTERVAL '1 hour'
    WHERE date_trunc('minute', e.ts) = date_trunc('minute', a.ts) OR date_trunc('minute', e.ts) + INTERVAL '1 minute' <= (SELECT t FROM closed))
  SELECT id AS alert_id, ts AS event_ts, src_ip, user_name AS event_user FROM p WHERE rn = 1""")
def _(spark, sf):
    """The latest event of the hour before each alert; earlier minutes count when the watermark has passed them."""
    audited = lambda: stream_of(spark, sf, "logs").filter(F.col("action").isin(*PRIVESC_ACTIONS))
    earlier = finished(spark, jobs.alert_audit_join(stream_of(spark, sf, "alerts"), jobs.minute_sources(audited(), "host")))
    own = finished(spark, jobs.alert_minute_join(stream_of(spark, sf, "alerts"), audited()))
    return jobs.latest_match(earlier.unionByName(own))


@query("r08_alert_latest_event", """WITH e AS (SELECT * FROM v_logs WHERE action IN ('ListUsers', 'CreateAccessKey', 'AttachUserPolicy', 'AssumeRole')),
  closed AS (SELECT date_trunc('milliseconds', least((SELECT max(ts) FROM e), (SELECT max(ts) FROM v_alerts))) - INTERVAL '120 seconds' AS t),
  p AS (SELECT a.id, e.ts, e.id AS event_id, e.src_ip, e.user_name, row_number() OVER (PARTITION BY a.id ORDER BY e.ts DESC, e.id DESC) AS rn FROM v_alerts a
    JOIN e ON e.host = a.host AND e.ts <= a.ts AND e.ts >= a.ts - INTERVAL '1 hour')
  SELECT a.id AS alert_id, a.ts AS alert_ts, p.ts AS event_ts, p.event_id, p.src_ip, p.user_name AS event_user FROM v_alerts a LEFT JOIN p ON p.id = a.id AND rn = 1
  WHERE a.ts <= (SELECT t FROM closed)""")
def _(spark, sf):
    """One row per alert that the watermark has passed, from one state operator over both streams."""
    audited = stream_of(spark, sf, "logs").filter(F.col("action").isin(*PRIVESC_ACTIONS))
    return finished(spark, state.alerts_with_latest_event(stream_of(spark, sf, "alerts"), audited))


@query("r09_stream_static_assets", """WITH c AS (SELECT host, ci_id, owner, row_number() OVER (PARTITION BY host ORDER BY ts DESC, ci_id DESC) AS rn FROM v_ci)
  SELECT a.id, a.host, c.ci_id, c.owner AS ci_owner FROM v_alerts a LEFT JOIN c ON c.host = a.host AND rn = 1""")
def _(spark, sf):
    return finished(spark, jobs.with_assets(stream_of(spark, sf, "alerts").select("id", "host"), view(spark, sf, "ci")))


@query("r10_deduplicate", "SELECT id, ts FROM v_logs")
def _(spark, sf):
    """Every event delivered twice, kept once."""
    once = stream_of(spark, sf, "logs").select("id", "ts")
    return finished(spark, jobs.deduplicated(once.unionByName(stream_of(spark, sf, "logs").select("id", "ts"))))


@query("a14_late_data_policy", f"SELECT {tb('15 minutes')} AS bucket, host, count(*) AS events, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM v_logs GROUP BY 1, 2 HAVING bucket + INTERVAL '15 minutes' <= {CLOSED}")
def _(spark, sf):
    """Job buckets under the 120-second query delay."""
    return finished(spark, jobs.bucket_stream(stream_of(spark, sf, "logs"), ["host"]))
