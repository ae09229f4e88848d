"""Registered anomaly detectors and trace analyses over the whole provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import anomalies as a
from skyledger.operators import dashboards, job_catalogue
from skyledger.operators import traces as t
from skyledger.plans.adapters import view
from skyledger.plans.dashboard_queries import logs, tb
from skyledger.plans.registry import query

SPAN = "1 hour"
SCORED = """, m AS (SELECT *, avg(x) OVER w AS mean, stddev_samp(x) OVER w AS sd, count(x) OVER w AS seen FROM b
    WINDOW w AS (PARTITION BY {key} ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
  z AS (SELECT *, round(100 * (1 - exp(-greatest({gap} / greatest(sd, 1e-9) - 2, 0) / 3)), 3) AS anomaly_score FROM m WHERE seen >= 8)"""


def score_sql(agg: str, by: str, where: str = "TRUE", side: str = "high", fill: bool = False, span: str = SPAN, source: str = "v_logs") -> str:
    gap = "(x - mean)" if side == "high" else "(mean - x)"
    body = f"SELECT {by}, {tb(span)} AS bucket, {agg} AS x FROM {source} WHERE {where} GROUP BY 1, 2"
    if fill:
        body = f"""SELECT s.{by}, s.bucket, coalesce(c.x, 0) AS x FROM (
      SELECT {by}, unnest(generate_series(min(bucket), max(bucket), INTERVAL '{span}')) AS bucket FROM ({body}) GROUP BY 1) s
    LEFT JOIN ({body}) c ON c.bucket = s.bucket AND c.{by} IS NOT DISTINCT FROM s.{by}"""
    return f"WITH b AS ({body})" + SCORED.format(key=by, gap=gap)


def detector(name: str, sql: str, by: str):
    return query(name, f"{sql} SELECT bucket, {by}, CAST(x AS DOUBLE) AS actual, anomaly_score FROM z WHERE anomaly_score > 0")


@query("a01_bucketise", f"SELECT {tb('15 minutes')} AS bucket, host, count(*) AS events, sum(duration_ms) / CAST(count(*) AS DOUBLE) AS mean FROM v_logs GROUP BY 1, 2")
def _(spark, sf):
    return a.bucketise(logs(spark, sf), {"events": F.count("*"), "mean": F.avg("duration_ms")}, ["host"])


@detector("a02_high_mean", score_sql("sum(duration_ms) / CAST(count(*) AS DOUBLE)", "host"), "host")
def _(spark, sf):
    return a.high_mean(logs(spark, sf), "duration_ms", ["host"], span=SPAN)


@detector("a03_high_count", score_sql("count(*)", "src_ip", "event_type = 'error'", fill=True), "src_ip")
def _(spark, sf):
    return a.high_count(logs(spark, sf), ["src_ip"], span=SPAN, where=F.col("outcome") == "failure")


@detector("a04_high_sum", score_sql("sum(bytes)", "dst_ip"), "dst_ip")
def _(spark, sf):
    return a.high_sum(logs(spark, sf), "bytes", ["dst_ip"], span=SPAN)


@detector("a05_high_max", score_sql("max(duration_ms)", "dag_id"), "dag_id")
def _(spark, sf):
    return a.high_max(logs(spark, sf), "duration_ms", ["dag_id"], span=SPAN)


@detector("a15_low_mean", score_sql("sum(duration_ms) / CAST(count(*) AS DOUBLE)", "host", side="low"), "host")
def _(spark, sf):
    return a.low_mean(logs(spark, sf), "duration_ms", ["host"], span=SPAN)


@query("a06_low_count", f"""WITH c AS (SELECT dataset, {tb(SPAN)} AS bucket, count(*) AS n FROM v_logs GROUP BY 1, 2),
  s AS (SELECT dataset, unnest(generate_series(min(bucket), TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '{SPAN}', INTERVAL '{SPAN}')) AS bucket FROM c GROUP BY 1),
  b AS (SELECT s.dataset, s.bucket, coalesce(c.n, 0) AS x FROM s LEFT JOIN c ON c.dataset = s.dataset AND c.bucket = s.bucket){SCORED.format(key="dataset", gap="(mean - x)")}
  SELECT bucket, dataset, CAST(x AS DOUBLE) AS actual, anomaly_score FROM z WHERE anomaly_score > 0""")
def _(spark, sf):
    return a.low_count(logs(spark, sf), ["dataset"], span=SPAN, as_of="2024-02-01 00:00:00")


@query("a07_rare", f"""WITH s AS (SELECT finding_type, qname, {tb(SPAN)} AS bucket, ts FROM v_logs)
  SELECT qname, count(DISTINCT bucket) AS buckets_seen, count(*) AS events, min(ts) AS first_seen, (SELECT count(DISTINCT bucket) FROM s) AS buckets_total
  FROM s GROUP BY qname HAVING count(DISTINCT bucket) / (SELECT count(DISTINCT bucket) FROM s) <= 0.05""")
def _(spark, sf):
    return a.rare(logs(spark, sf), "qname", span=SPAN)


@query("a08_rare_by_partition", f"""WITH s AS (SELECT user_name, action, {tb(SPAN)} AS bucket, ts FROM v_logs),
  p AS (SELECT user_name, count(DISTINCT bucket) AS buckets_total FROM s GROUP BY 1),
  v AS (SELECT user_name, action, count(DISTINCT bucket) AS buckets_seen, count(*) AS events, min(ts) AS first_seen FROM s GROUP BY 1, 2)
  SELECT v.*, buckets_total FROM v JOIN p USING (user_name) WHERE buckets_seen / buckets_total <= 0.05""")
def _(spark, sf):
    return a.rare(logs(spark, sf), "action", ["user_name"], span=SPAN)


@query("a09_multi_detector", score_sql("sum(duration_ms) / CAST(count(*) AS DOUBLE)", "host") + """,
  y AS (SELECT bucket, host, CAST(x AS DOUBLE) AS actual, anomaly_score, 'duration' AS detector FROM z WHERE anomaly_score > 0)
  SELECT * FROM y UNION ALL SELECT * FROM (""" + score_sql("sum(bytes)", "host") + """
  SELECT bucket, host, CAST(x AS DOUBLE), anomaly_score, 'bytes' FROM z WHERE anomaly_score > 0)""")
def _(spark, sf):
    df = logs(spark, sf)
    return a.multi_detector({"duration": a.high_mean(df, "duration_ms", ["host"], span=SPAN), "bytes": a.high_sum(df, "bytes", ["host"], span=SPAN)})


@query("a10_influencers", score_sql("sum(bytes)", "host") + f""",
  r AS (SELECT z.bucket, z.host, l.region, l.dataset FROM z JOIN v_logs l ON l.host = z.host AND {tb(SPAN, 'l.ts')} = z.bucket WHERE anomaly_score > 0),
  c AS (SELECT bucket, host, 'region' AS field, region AS value, count(*) AS "rows" FROM r GROUP BY 1, 2, 3, 4
    UNION ALL SELECT bucket, host, 'dataset', dataset, count(*) FROM r GROUP BY 1, 2, 3, 4),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY bucket, host, field ORDER BY "rows" DESC, value NULLS LAST) AS INTEGER) AS rank,
    round("rows" / sum("rows") OVER (PARTITION BY bucket, host, field), 4) AS share FROM c)
  SELECT * FROM k WHERE rank <= 3""")
def _(spark, sf):
    df = logs(spark, sf)
    return a.influencers(a.high_sum(df, "bytes", ["host"], span=SPAN), df, ["host"], ["region", "dataset"], span=SPAN)


@query("a11_anomaly_bands", score_sql("count(*)", "dataset", fill=True) + """ SELECT bucket, dataset, CAST(x AS DOUBLE) AS actual, anomaly_score,
  CASE WHEN anomaly_score > 75 THEN 'critical' WHEN anomaly_score > 50 THEN 'warning' ELSE 'minor' END AS band FROM z WHERE anomaly_score > 0""")
def _(spark, sf):
    return a.anomaly_bands(a.high_count(logs(spark, sf), ["dataset"], span=SPAN))


def _jobs_sql() -> str:
    where = {
        "aws-vpcflow-high-bytes-tx": "k % 2 = 0", "aws-vpcflow-high-denied-count": "event_type = 'error'", "aws-guardduty-finding-spike": "kind = 'alert'",
        "aws-waf-high-block-rate": "event_type = 'error' AND k % 2 = 0", "aws-nlb-unhealthy-host-spike": "TRUE",
        "aws-lambda-duration-spike": "TRUE", "aws-stream-throughput-drop": "TRUE",
    }
    agg = {"high_sum": "sum({c})", "high_count": "count(*)", "low_count": "count(*)", "high_mean": "sum({c}) / CAST(count(*) AS DOUBLE)", "high_max": "max({c})"}
    parts = []
    for j in a.JOBS:
        sql = score_sql(agg[j.function].format(c=j.column), j.by, where[j.id], "low" if j.function == "low_count" else "high", j.function.endswith("count"))
        parts.append(f"SELECT * FROM ({sql} SELECT '{j.id}' AS job_id, {j.by} AS partition_value, bucket AS ts, CAST(x AS DOUBLE) AS actual, anomaly_score FROM z WHERE anomaly_score > 0)")
    return " UNION ALL ".join(parts)


@query("a12_job_catalogue", _jobs_sql())
def _(spark, sf):
    return a.run_jobs(logs(spark, sf), span=SPAN)


@query("a12_rare_jobs", f"""WITH s AS (
    SELECT 'aws-guardduty-rare-finding-type' AS job_id, '*' AS partition_value, finding_type AS value, {tb(SPAN)} AS bucket, ts FROM v_logs WHERE kind = 'alert'
    UNION ALL SELECT 'aws-cloudtrail-rare-user-action', user_name, action, {tb(SPAN)}, ts FROM v_logs
    UNION ALL SELECT 'aws-kms-unusual-operation', account, action, {tb(SPAN)}, ts FROM v_logs),
  p AS (SELECT job_id, partition_value, count(DISTINCT bucket) AS buckets_total FROM s GROUP BY 1, 2),
  v AS (SELECT job_id, partition_value, value, count(DISTINCT bucket) AS buckets_seen, count(*) AS events, min(ts) AS first_seen FROM s GROUP BY 1, 2, 3)
  SELECT v.*, buckets_total FROM v JOIN p USING (job_id, partition_value) WHERE buckets_seen / buckets_total <= 0.05""")
def _(spark, sf):
    return a.run_rare_jobs(logs(spark, sf), span=SPAN)


def job_logs(spark, sf):
    """Log rows with the catalogue's stream as their dataset."""
    return view(spark, sf, "job_logs").withColumn("dataset", F.col("stream")).drop("stream")


JOB_COLUMNS = """id ts dataset region account kind category action level outcome severity_num severity user_name target_user src_ip dst_ip country host bytes direction duration_ms
  error_code error_type message session qname rcode rule_category rule_name tactic technique finding_type bucket_name object_key requester additional_count dag_id
  rows_returned workgroup resource status_code cold_start dst_port""".split()
METRIC_JOBS = [j for j in job_catalogue.split_runnable(JOB_COLUMNS)[0] if j.function != "rare"]
RARE_VALUES = [j for j in job_catalogue.split_runnable(JOB_COLUMNS)[0] if j.function == "rare"]


def _catalogue_sql(until: str = "TIMESTAMP '2024-02-01 00:00:00'") -> str:
    """Every runnable metric job written out as a query of its own over the rows of its stream."""
    value = {"high_sum": "sum({c})", "high_mean": "sum({c}) / CAST(count({c}) AS DOUBLE)", "low_mean": "sum({c}) / CAST(count({c}) AS DOUBLE)", "high_max": "max({c})"}
    series = " UNION ALL ".join(
        f"SELECT '{j.id}' AS job_id, '{j.function}' AS function, {f'CAST({j.by} AS VARCHAR)' if j.by else repr('*')} AS partition_value, {tb(SPAN)} AS bucket, "
        f"CAST({value.get(j.function, 'count(*)').format(c=j.field)} AS DOUBLE) AS x FROM j WHERE stream = '{j.stream}' AND ({job_catalogue.CONDITIONS[j.condition][1]}) GROUP BY 3, 4"
        for j in METRIC_JOBS
    )
    return f"""WITH j AS MATERIALIZED (SELECT * FROM v_job_logs), c AS MATERIALIZED ({series}),
  s AS (SELECT job_id, function, partition_value, unnest(generate_series(min(bucket), {until} - INTERVAL '{SPAN}', INTERVAL '{SPAN}')) AS bucket FROM c WHERE function LIKE '%_count' GROUP BY 1, 2, 3),
  f AS (SELECT s.*, coalesce(c.x, 0) AS x FROM s LEFT JOIN c ON c.job_id = s.job_id AND c.function = s.function AND c.bucket = s.bucket AND c.partition_value IS NOT DISTINCT FROM s.partition_value
    UNION ALL SELECT job_id, function, partition_value, bucket, x FROM c WHERE function NOT LIKE '%_count'),
  m AS (SELECT *, avg(x) OVER w AS mean, stddev_samp(x) OVER w AS sd, count(x) OVER w AS seen FROM f
    WINDOW w AS (PARTITION BY job_id, function, partition_value ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
  z AS (SELECT *, round(100 * (1 - exp(-greatest(CASE WHEN function LIKE 'low_%' THEN mean - x ELSE x - mean END / greatest(sd, 1e-9) - 2, 0) / 3)), 3) AS anomaly_score FROM m WHERE seen >= 8)
  SELECT job_id, partition_value, bucket AS ts, x AS actual, anomaly_score FROM z WHERE anomaly_score > 0"""


@query("a12_full_catalogue", _catalogue_sql())
def _(spark, sf):
    """Every catalogued job that the rows have the fields for, up to a fixed instant."""
    return job_catalogue.run_catalogue(job_logs(spark, sf), span=SPAN, as_of="2024-02-01 00:00:00")


def _rare_catalogue_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{j.id}' AS job_id, {f'CAST({j.by} AS VARCHAR)' if j.by else repr('*')} AS partition_value, CAST({j.field} AS VARCHAR) AS value, {tb(SPAN)} AS bucket, ts FROM j WHERE stream = '{j.stream}'"
        for j in RARE_VALUES
    )
    return f"""WITH j AS MATERIALIZED (SELECT * FROM v_job_logs), s AS MATERIALIZED ({rows}),
  p AS (SELECT job_id, partition_value, count(DISTINCT bucket) AS buckets_total FROM s GROUP BY 1, 2),
  v AS (SELECT job_id, partition_value, value, count(DISTINCT bucket) AS buckets_seen, count(*) AS events, min(ts) AS first_seen FROM s GROUP BY 1, 2, 3)
  SELECT v.*, buckets_total FROM v JOIN p USING (job_id, partition_value) WHERE buckets_seen / buckets_total <= 0.05"""


@query("a12_full_rare", _rare_catalogue_sql())
def _(spark, sf):
    return job_catalogue.run_rare_catalogue(job_logs(spark, sf), span=SPAN)


@query("q22_anomaly_leaderboard", f"""SELECT job_id, max(anomaly_score) AS max_score, max(ts) AS latest FROM ({_jobs_sql()})
  WHERE anomaly_score > 0 AND job_id LIKE 'aws-%' GROUP BY job_id ORDER BY max_score DESC, job_id LIMIT 20""")
def _(spark, sf):
    return dashboards.anomaly_leaderboard(a.run_jobs(logs(spark, sf), span=SPAN), "aws-*")


@query("a13_datafeed_filter", """SELECT id FROM v_logs WHERE dataset = 'aws.cloudtrail' AND host LIKE 'host-1%' AND dst_ip IS NOT NULL AND finding_type LIKE 'Trojan:%'""")
def _(spark, sf):
    where = a.datafeed_filter({"dataset": "aws.cloudtrail"}, {"host": "host-1"}, ["dst_ip"], {"finding_type": "Trojan:*"})
    return logs(spark, sf).filter(where).select("id")


# ---- traces ---------------------------------------------------------------------------------------------------


def spans(spark, sf):
    return view(spark, sf, "spans")


KIND_SQL = """CASE WHEN type = 'messaging' OR coalesce(subtype, '') IN ('sns', 'sqs', 'kafka', 'kinesis', 'eventbridge')
    THEN CASE WHEN lower(coalesce(action, '')) LIKE '%receiv%' THEN 'CONSUMER' ELSE 'PRODUCER' END
  WHEN type IN ('db', 'external', 'http', 'storage', 'aws') OR coalesce(subtype, '') <> '' THEN 'CLIENT' ELSE 'INTERNAL' END"""


@query("t01_otlp_spans", f"""SELECT trace_id AS "traceId", coalesce(span_id, tx_id) AS "spanId", parent_id AS "parentSpanId", name,
  CAST(CASE WHEN kind = 'span' THEN CASE {KIND_SQL} WHEN 'CONSUMER' THEN 5 WHEN 'PRODUCER' THEN 4 WHEN 'CLIENT' THEN 3 ELSE 1 END
    WHEN type = 'messaging' THEN 5 ELSE 2 END AS INTEGER) AS kind,
  epoch_ms(ts) || '000000' AS "startTimeUnixNano", CAST(epoch_ms(ts) * 1000000 + duration_us * 1000 AS VARCHAR) AS "endTimeUnixNano",
  concat_ws(',', CASE WHEN kind = 'span' AND subtype IS NOT NULL THEN 'db.system=' || subtype END, CASE WHEN kind = 'span' THEN 'db.operation=' || action END,
    CASE WHEN kind = 'span' AND type = 'external' THEN 'rpc.system=aws-api' END, CASE WHEN kind = 'span' THEN 'peer.service=' || peer END,
    CASE WHEN kind = 'transaction' AND result IN ('200', '503') THEN 'http.response.status_code=' || result END) AS attributes,
  CAST(CASE outcome WHEN 'failure' THEN 2 WHEN 'success' THEN 1 ELSE 0 END AS INTEGER) AS status FROM v_spans""")
def _(spark, sf):
    df = spans(spark, sf)
    df = df.withColumn("span_kind", F.when(F.col("kind") == "span", t.span_kind_name(F.col("type"), F.col("subtype"), F.col("action"))))
    out = t.apm_to_otlp_span(df)
    shown = F.array_join(F.transform("attributes", lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value.stringValue, e.value.intValue))), ",")
    return out.withColumns({"attributes": shown, "status": F.col("status.code")})


@query("t02_resource_spans", """WITH s AS (SELECT *, CASE WHEN service LIKE '%4' THEN NULL ELSE service END AS name_of, environment AS env FROM v_spans)
  SELECT coalesce(name_of, 'unknown') AS service, coalesce(env, '') AS environment, name_of AS service_name, env AS deployment,
    CASE WHEN name_of LIKE '%1' THEN 'gcp' WHEN name_of LIKE '%2' THEN 'azure' ELSE 'aws' END AS provider, CASE WHEN name_of LIKE '%svc%' THEN 'eu-west-1' END AS region,
    CASE WHEN name_of LIKE '%3' THEN 'elastic' ELSE 'opentelemetry' END AS scope, count(*) AS spans, count(DISTINCT trace_id) AS traces,
    CAST(sum(duration_us) * 1000 AS BIGINT) AS nanos, count(CASE WHEN parent_id <> '' THEN 1 END) AS children FROM s GROUP BY 1, 2, 3, 4, 5, 6, 7""")
def _(spark, sf):
    named = spans(spark, sf).withColumn("service", F.when(~F.col("service").like("%4"), F.col("service")))
    df = named.withColumns({
        "vendor": F.when(F.col("service").like("%1"), "gcp").when(F.col("service").like("%2"), "azure"),
        "region": F.when(F.col("service").like("%svc%"), "eu-west-1"), "sdk_name": F.when(F.col("service").like("%3"), "elastic"),
    })
    shown = F.col("resourceSpans.resource.attributes")
    value = lambda key: F.get(F.filter(shown, lambda x: x["key"] == key), 0)["value"]["stringValue"]
    scope = F.col("resourceSpans.scopeSpans")[0]
    one = t.group_resource_spans(df).select(
        "service", "environment", value("service.name").alias("service_name"), value("deployment.environment").alias("deployment"), value("cloud.provider").alias("provider"),
        value("cloud.region").alias("region"), scope["scope"]["name"].alias("scope"), F.explode(scope["spans"]).alias("s"),
    )
    nanos = F.sum(F.col("s.endTimeUnixNano").cast("long") - F.col("s.startTimeUnixNano").cast("long"))
    return one.groupBy("service", "environment", "service_name", "deployment", "provider", "region", "scope").agg(
        F.count("*").alias("spans"), F.count_distinct("s.traceId").alias("traces"), nanos.alias("nanos"), F.count("s.parentSpanId").alias("children")
    )


@query("t03_span_kind", f"SELECT trace_id, span_id, {KIND_SQL} AS kind FROM v_spans WHERE kind = 'span'")
def _(spark, sf):
    return spans(spark, sf).filter("kind = 'span'").select("trace_id", "span_id", t.span_kind_name(F.col("type"), F.col("subtype"), F.col("action")).alias("kind"))


@query("t04_http_status", "SELECT trace_id, CAST(CASE result WHEN '200' THEN 200 WHEN '503' THEN 503 END AS INTEGER) AS status FROM v_spans WHERE kind = 'transaction'")
def _(spark, sf):
    return spans(spark, sf).filter("kind = 'transaction'").select("trace_id", t.http_status(F.col("result")).alias("status"))


@query("t05_typed_attributes", """SELECT id, 'b:' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',i:' || k || CASE WHEN k % 4 = 0 THEN ',i:' || (k // 4) ELSE ',d:' || (k / 4.0::DOUBLE) END || ',s:' || event_type AS attributes
  FROM v_logs""")
def _(spark, sf):
    doc = F.format_string('{"a":%s,"b":%d,"c":%s,"e":"","n":null,"s":"%s"}', (F.col("k") % 2 == 0).cast("string"), F.col("k"), (F.col("k") / 4.0).cast("string"), F.col("event_type"))
    out = logs(spark, sf).select("id", t.typed_attributes(doc).alias("x"))
    v = lambda e: F.coalesce(
        F.concat(F.lit("b:"), e.value.boolValue.cast("string")), F.concat(F.lit("i:"), e.value.intValue),
        F.concat(F.lit("d:"), e.value.doubleValue.cast("string")), F.concat(F.lit("s:"), e.value.stringValue),
    )
    return out.select("id", F.array_join(F.transform("x", v), ",").alias("attributes"))


@query("t06_service_map", """SELECT p.service AS caller, c.service AS callee, count(*) AS calls, count(*) FILTER (WHERE c.outcome = 'failure') AS failures,
  sum(c.duration_us) / CAST(count(*) AS DOUBLE) AS mean_us FROM v_spans c JOIN v_spans p ON c.trace_id = p.trace_id AND c.parent_id = coalesce(p.span_id, p.tx_id) GROUP BY 1, 2""")
def _(spark, sf):
    return t.service_map(spans(spark, sf))


@query("t07_trace_integrity", """WITH o AS (SELECT c.trace_id, count(*) AS n FROM v_spans c WHERE c.parent_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM v_spans p WHERE p.trace_id = c.trace_id AND coalesce(p.span_id, p.tx_id) = c.parent_id) GROUP BY 1),
  d AS (SELECT trace_id, count(*) AS docs, count(*) FILTER (WHERE parent_id IS NULL) AS roots FROM v_spans GROUP BY 1)
  SELECT d.trace_id, docs, roots, coalesce(n, 0) AS orphans, docs >= 2 AND roots = 1 AND coalesce(n, 0) = 0 AS valid FROM d LEFT JOIN o USING (trace_id)""")
def _(spark, sf):
    return t.trace_integrity(spans(spark, sf))


def errors(spark, sf):
    """Error documents derived from failed spans; some are malformed."""
    df = spans(spark, sf).filter("kind = 'span' AND outcome = 'failure'")
    n = F.substring("span_id", 1, 1)
    exc = F.array(F.struct(F.lit("IOError").alias("type"), F.when(n == "1", "").otherwise("boom").alias("message")))
    return df.select(
        "trace_id", "span_id", F.when(n == "2", F.substring("tx_id", 1, 4)).otherwise(F.col("tx_id")).alias("tx_id"), F.col("span_id").alias("parent_id"),
        F.md5("span_id").alias("error_id"), F.when(n != "3", "g").alias("grouping_key"), F.when(n != "4", exc).alias("exception"),
        F.lit("logs").alias("stream_type"), F.when(n == "5", "apm.other").otherwise("apm.error").alias("dataset"),
    )


@query("t08_error_integrity", """SELECT span_id, CASE substr(span_id, 1, 1) WHEN '1' THEN 'exception_message' WHEN '2' THEN 'transaction_id' WHEN '3' THEN 'grouping_key'
  WHEN '4' THEN 'exception,exception_type,exception_message' WHEN '5' THEN 'dataset' ELSE '' END AS violations FROM v_spans WHERE kind = 'span' AND outcome = 'failure'""")
def _(spark, sf):
    return t.error_doc_integrity(errors(spark, sf)).select("span_id", "violations")


@query("t09_error_transaction_join", """WITH e AS (SELECT span_id, trace_id, CASE WHEN substr(span_id, 1, 1) <> '2' THEN tx_id END AS tx_id FROM v_spans WHERE kind = 'span' AND outcome = 'failure'),
  x AS (SELECT trace_id, tx_id, name, result, service FROM v_spans WHERE kind = 'transaction')
  SELECT e.span_id, x.name AS tx_name, x.result AS tx_result, x.service AS tx_service FROM e LEFT JOIN x ON x.trace_id = e.trace_id AND x.tx_id = e.tx_id""")
def _(spark, sf):
    return t.apm_error_join(errors(spark, sf), spans(spark, sf).filter("kind = 'transaction'")).select("span_id", "tx_name", "tx_result", "tx_service")


@detector("t10_span_latency_by_type", score_sql("sum(duration_us) / CAST(count(*) AS DOUBLE)", "type", "kind = 'span'", span="1 day", source="v_spans"), "type")
def _(spark, sf):
    return t.span_latency_by_type(spans(spark, sf))


@query("t11_broken_traces", """WITH e AS (SELECT * FROM (VALUES (1, 'land'), (2, 'start'), (3, 'read'), (4, 'spark'), (5, 'crawler'), (6, 'query'), (7, 'done')) e(pos, name)),
  f AS (SELECT run_id, min(step) AS failed_pos FROM v_stages WHERE outcome = 'failure' GROUP BY 1)
  SELECT f.run_id, (SELECT name FROM e WHERE pos = f.failed_pos) AS failed_stage, string_agg(e.name, ',' ORDER BY e.pos) AS missing
  FROM f JOIN e ON e.pos > f.failed_pos LEFT JOIN v_stages s ON s.run_id = f.run_id AND s.stage = e.name WHERE s.run_id IS NULL GROUP BY f.run_id, f.failed_pos""")
def _(spark, sf):
    return t.broken_runs(view(spark, sf, "stages"))


@query("t12_trace_log_join", """SELECT l.id, s.trace_id, s.service, s.name AS tx_name FROM v_logs l JOIN v_spans s ON s.kind = 'transaction' AND s.trace_id = md5(CAST(l.id AS VARCHAR))""")
def _(spark, sf):
    key = F.md5(F.col("id").cast("string"))
    dashed = F.concat_ws("-", F.substring(key, 1, 8), F.substring(key, 9, 24))
    df = logs(spark, sf).select(
        "id", F.when(F.col("k") % 2 == 0, F.concat(F.lit("projects/p/traces/"), key)).alias("gcp_trace"), F.when(F.col("k") % 2 == 1, dashed).alias("operation_id")
    )
    return t.trace_log_join(df, spans(spark, sf).filter("kind = 'transaction'")).drop("gcp_trace", "operation_id")
