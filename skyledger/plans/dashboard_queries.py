"""Registered dashboard and triage queries over the whole provided tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skyledger.operators import dashboards as d
from skyledger.plans.adapters import table, view
from skyledger.plans.registry import query

# The provided events end on 2024-01-30; a 30-day look-back from here covers them all.
AS_OF = "2024-01-31 00:00:00"
HOURS = 720
START, END = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)


def logs(spark, sf):
    return view(spark, sf, "logs")


def rnd(expr: str) -> str:
    """Decimal rounding in the oracle, half up as Spark rounds."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), 2) AS DOUBLE)"


def tb(width: str, col: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{width}', {col}, TIMESTAMP '1970-01-01')"


@query("q01_kpi_count", "SELECT count(*) AS value FROM v_logs")
def _(spark, sf):
    return d.kpi_count(logs(spark, sf))


@query("q02_kpi_count_where", "SELECT count(*) AS value FROM v_logs WHERE event_type = 'error'")
def _(spark, sf):
    return d.kpi_count(logs(spark, sf), F.col("event_type") == "error")


@query("q03_kpi_count_distinct", "SELECT count(DISTINCT region) AS value FROM v_logs WHERE region IS NOT NULL")
def _(spark, sf):
    return d.kpi_count_distinct(logs(spark, sf), "region", not_null=True)


@query("q04_kpi_sum", "SELECT CAST(sum(bytes) AS BIGINT) AS value FROM v_logs")
def _(spark, sf):
    return d.kpi(logs(spark, sf), "sum", "bytes")


@query("q04_kpi_avg", "SELECT sum(bytes) / CAST(count(bytes) AS DOUBLE) AS value FROM v_logs")
def _(spark, sf):
    return d.kpi(logs(spark, sf), "avg", "bytes")


@query("q05_kpi_round_avg", f"SELECT {rnd('avg(duration_ms)')} AS value FROM v_logs")
def _(spark, sf):
    return d.kpi(logs(spark, sf), "avg", "duration_ms", digits=2)


@query("q05_kpi_round_sum", f"SELECT {rnd('sum(duration_ms)')} AS value FROM v_logs")
def _(spark, sf):
    return d.kpi(logs(spark, sf), "sum", F.col("duration_ms").cast("double"), digits=2)


@query("q06_kpi_sum_scaled", f"SELECT {rnd('sum(bytes) / 1048576.0')} AS value FROM v_logs")
def _(spark, sf):
    return d.kpi(logs(spark, sf), "sum", "bytes", digits=2, scale=1048576.0)


@query("q07_count_by", "SELECT region, count(*) AS events FROM v_logs GROUP BY region")
def _(spark, sf):
    return d.count_by(logs(spark, sf), "region")


@query("q08_top_n_by", "SELECT src_ip, count(*) AS events FROM v_logs GROUP BY src_ip ORDER BY events DESC, src_ip LIMIT 10")
def _(spark, sf):
    return d.top_n_by(logs(spark, sf), ["src_ip"], 10)


@query("q09_top_n_coalesce", """SELECT coalesce(dst_ip, 'unknown') AS dst_ip, count(*) AS events FROM v_logs
  GROUP BY 1 ORDER BY events DESC, dst_ip LIMIT 15""")
def _(spark, sf):
    return d.top_n_coalesce(logs(spark, sf), "dst_ip", "unknown", 15)


@query("q10_timeline_auto_count", f"SELECT {tb('12 hours')} AS bucket, count(*) AS events FROM v_logs GROUP BY 1")
def _(spark, sf):
    return d.timeline_auto(logs(spark, sf), START, END, {"events": F.count("*")})


@query("q11_timeline_auto_avg", f"SELECT {tb('12 hours')} AS bucket, {rnd('avg(duration_ms)')} AS mean FROM v_logs GROUP BY 1")
def _(spark, sf):
    return d.timeline_auto(logs(spark, sf), START, END, {"mean": F.round(F.avg("duration_ms"), 2)})


@query("q12_timeline_auto_sum", f"SELECT {tb('12 hours')} AS bucket, {rnd('sum(bytes) / 1048576.0')} AS mib FROM v_logs GROUP BY 1")
def _(spark, sf):
    return d.timeline_auto(logs(spark, sf), START, END, {"mib": F.round(F.sum("bytes") / 1048576.0, 2)})


@query("q13_timeline_fixed", f"""SELECT {tb('15 minutes')} AS bucket, count(*) AS failures FROM v_logs
  WHERE outcome = 'failure' GROUP BY 1""")
def _(spark, sf):
    return d.timeline(logs(spark, sf).filter("outcome = 'failure'"), "15 minutes", {"failures": F.count("*")})


@query("q14_timeline_by_category", f"SELECT {tb('15 minutes')} AS bucket, category, count(*) AS events FROM v_logs GROUP BY 1, 2")
def _(spark, sf):
    return d.timeline(logs(spark, sf), "15 minutes", {"events": F.count("*")}, by=["category"])


@query("q15_multi_key_multi_agg", f"""SELECT dataset, region, category, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS total_bytes,
  max(duration_ms) AS slowest, {rnd('avg(duration_ms)')} AS mean FROM v_logs GROUP BY 1, 2, 3
  ORDER BY events DESC, dataset, region NULLS LAST, category LIMIT 50""")
def _(spark, sf):
    aggs = {
        "events": F.count("*"), "total_bytes": F.sum("bytes"), "slowest": F.max("duration_ms"),
        "mean": F.round(F.avg("duration_ms"), 2),
    }
    order = [F.desc("events"), F.asc("dataset"), F.asc_nulls_last("region"), F.asc("category")]
    return d.aggregate_by(logs(spark, sf), ["dataset", "region", "category"], aggs, order=order, limit=50)


@query("q16_recent_events", "SELECT ts, action, outcome, user_name FROM v_logs ORDER BY ts DESC, id LIMIT 100")
def _(spark, sf):
    return d.recent_events(logs(spark, sf), ["ts", "action", "outcome", "user_name"], 100)


@query("q17_wildcard_filter", """SELECT id, finding_type FROM v_logs
  WHERE finding_type LIKE 'Exfiltration%' OR finding_type LIKE '%Port_robe'""")
def _(spark, sf):
    return d.wildcard_filter(logs(spark, sf), "finding_type", ["Exfiltration*", "%Port?robe"]).select("id", "finding_type")


@query("q18_filtered_aggregate", """SELECT workgroup, count(*) AS total, count(*) FILTER (WHERE rows_returned = 0) AS matching
  FROM v_logs GROUP BY workgroup""")
def _(spark, sf):
    return d.filtered_aggregate(logs(spark, sf), ["workgroup"], F.col("rows_returned") == 0)


@query("q19_error_summary", """SELECT dataset, region, error_code, count(*) AS error_count FROM v_logs WHERE outcome = 'failure'
  GROUP BY 1, 2, 3 ORDER BY error_count DESC, dataset, region NULLS LAST, error_code NULLS LAST LIMIT 20""")
def _(spark, sf):
    return d.error_summary(logs(spark, sf), AS_OF, HOURS)


@query("q20_service_health", f"""SELECT dataset, count(*) AS total, count(*) FILTER (WHERE outcome = 'failure') AS failures,
  {rnd("count(*) FILTER (WHERE outcome = 'failure') * 100.0 / count(*)")} AS error_rate
  FROM v_logs GROUP BY dataset ORDER BY error_rate DESC, dataset LIMIT 20""")
def _(spark, sf):
    return d.service_health(logs(spark, sf), AS_OF, HOURS)


@query("q21_top_errors", """SELECT error_code, message, count(*) AS "count" FROM v_logs WHERE outcome = 'failure'
  GROUP BY 1, 2 ORDER BY 3 DESC, error_code, message LIMIT 15""")
def _(spark, sf):
    return d.top_errors(logs(spark, sf), AS_OF, HOURS)


@query("q23_trace_latency", """SELECT service, quantile_cont(duration_us, 0.5) AS p50, quantile_cont(duration_us, 0.95) AS p95,
  quantile_cont(duration_us, 0.99) AS p99, count(*) AS throughput FROM v_spans WHERE kind = 'transaction' AND service LIKE 'aws-%'
  GROUP BY service ORDER BY p99 DESC, service LIMIT 20""")
def _(spark, sf):
    return d.trace_latency(view(spark, sf, "spans").filter("kind = 'transaction'"), "aws-*", exact=True)


@query("q24_finding_summary", """SELECT rule_name, outcome, count(*) AS "count" FROM v_logs
  WHERE kind = 'alert' OR category = 'configuration' GROUP BY 1, 2
  ORDER BY 3 DESC, rule_name NULLS LAST, outcome NULLS LAST LIMIT 20""")
def _(spark, sf):
    return d.finding_summary(logs(spark, sf), AS_OF, HOURS)


@query("q25_attack_timeline", """SELECT action, dataset, src_ip, user_name, ts, count(*) AS "count" FROM v_logs
  WHERE session IS NOT NULL OR category = 'intrusion_detection' GROUP BY 1, 2, 3, 4, 5
  ORDER BY ts, action, dataset, src_ip, user_name LIMIT 50""")
def _(spark, sf):
    return d.attack_timeline(logs(spark, sf), AS_OF, HOURS)


@query("q26_privesc_details", """SELECT ts, action, user_name, src_ip, outcome, session, target_user, tactic, technique FROM v_logs
  WHERE category = 'iam' AND action IN ('ListUsers', 'CreateAccessKey', 'AttachUserPolicy', 'AssumeRole') ORDER BY ts, id LIMIT 50""")
def _(spark, sf):
    return d.privesc_details(logs(spark, sf), AS_OF, HOURS)


@query("q27_ip_activity", """SELECT dataset, action, outcome, count(*) AS actions FROM v_logs WHERE src_ip = '10.0.1.2'
  GROUP BY 1, 2, 3 ORDER BY actions DESC, dataset, action, outcome NULLS LAST LIMIT 30""")
def _(spark, sf):
    return d.ip_activity(logs(spark, sf), "10.0.1.2", AS_OF, HOURS)


@query("q28_open_alert_summary", """SELECT rule, severity, risk, count(*) AS "count" FROM v_alerts
  WHERE status IS NOT NULL AND status <> 'closed' GROUP BY 1, 2, 3 ORDER BY 4 DESC, rule LIMIT 30""")
def _(spark, sf):
    return d.open_alert_summary(view(spark, sf, "alerts"), AS_OF, HOURS)


@query("q29_cmdb_lookup", """SELECT name, ip, host, owner, department, category FROM v_ci
  WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31' ORDER BY ts DESC, ci_id LIMIT 20""")
def _(spark, sf):
    return d.cmdb_lookup(view(spark, sf, "ci"), AS_OF, ["name", "ip", "host", "owner", "department", "category"])


@query("q30_guardduty_summary", """SELECT action, severity_num, src_ip, count(*) AS "count" FROM v_logs GROUP BY 1, 2, 3
  ORDER BY severity_num DESC NULLS LAST, 4 DESC, action, src_ip LIMIT 20""")
def _(spark, sf):
    return d.guardduty_summary(logs(spark, sf), AS_OF, HOURS)


@query("q31_failure_concentration", """SELECT dag_id, count(*) AS failures FROM v_logs WHERE outcome = 'failure'
  GROUP BY dag_id ORDER BY failures DESC, dag_id LIMIT 10""")
def _(spark, sf):
    return d.top_n_by(logs(spark, sf), ["dag_id"], 10, where=F.col("outcome") == "failure", name="failures")


@query("q32_empty_ratio_baseline", f"""WITH h AS (SELECT {tb('1 hour')} AS bucket, count(*) AS total,
    count(*) FILTER (WHERE rows_returned = 0) AS empty FROM v_logs GROUP BY 1),
  p AS (SELECT *, {rnd('empty * 100.0 / total')} AS empty_pct FROM h)
  SELECT *, CASE WHEN empty_pct <= 1 THEN 'normal' WHEN empty_pct >= 25 THEN 'degraded' ELSE 'elevated' END AS reading FROM p""")
def _(spark, sf):
    return d.empty_ratio_baseline(logs(spark, sf))


@query("q33_error_classification", """SELECT error_type, host, count(*) AS events FROM v_logs WHERE error_type IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return d.count_by(logs(spark, sf).filter(F.col("error_type").isNotNull()), "error_type", "host")


@query("q34_bad_key_producers", """SELECT requester, bucket_name, count(*) AS bad_keys FROM v_logs
  WHERE NOT object_key LIKE '%.avro' GROUP BY 1, 2""")
def _(spark, sf):
    return d.bad_key_producers(logs(spark, sf))


@query("q35_runtime_percentiles", """SELECT dag_id, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99
  FROM v_logs GROUP BY dag_id HAVING quantile_cont(duration_ms, 0.95) > 30000""")
def _(spark, sf):
    return d.runtime_percentiles(logs(spark, sf), exact=True)


@query("q36_host_dns_profile", """SELECT host, src_ip, count(*) AS queries, count(DISTINCT qname) AS unique_domains FROM v_logs
  WHERE qname LIKE '%duckdns.org' OR qname LIKE '%ngrok.io' OR qname LIKE '%serveo.net' OR qname LIKE '%.xyz'
  GROUP BY 1, 2 ORDER BY queries DESC, host, src_ip LIMIT 20""")
def _(spark, sf):
    return d.host_dns_profile(logs(spark, sf))


@query("q37_nxdomain_rate", """SELECT host, count(*) AS total, CAST(sum(CASE WHEN rcode = 'NXDOMAIN' THEN 1 ELSE 0 END) AS BIGINT) AS nxdomain
  FROM v_logs GROUP BY host""")
def _(spark, sf):
    return d.nxdomain_rate(logs(spark, sf))


@query("q38_daily_unique_domains", """SELECT host, date_trunc('day', ts) AS bucket, count(DISTINCT qname) AS daily_unique
  FROM v_logs GROUP BY 1, 2""")
def _(spark, sf):
    return d.timeline(logs(spark, sf), "1 day", {"daily_unique": F.count_distinct("qname")}, by=["host"])


@query("q39_egress_by_source", """SELECT src_ip, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS flows FROM v_logs
  WHERE direction = 'egress' AND bytes > 52428800 GROUP BY 1 ORDER BY total_bytes DESC, src_ip LIMIT 25""")
def _(spark, sf):
    return d.egress_by(logs(spark, sf), ["src_ip"])


@query("q39_egress_by_destination", """SELECT dst_ip, country, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS flows FROM v_logs
  WHERE direction = 'egress' AND bytes > 52428800 GROUP BY 1, 2
  ORDER BY total_bytes DESC, dst_ip NULLS LAST, country NULLS LAST LIMIT 25""")
def _(spark, sf):
    return d.egress_by(logs(spark, sf), ["dst_ip", "country"])


@query("q40_findings_by_entity", "SELECT src_ip, account, user_name, count(*) AS findings FROM v_logs WHERE kind = 'alert' GROUP BY 1, 2, 3")
def _(spark, sf):
    return d.count_by(logs(spark, sf).filter("kind = 'alert'"), "src_ip", "account", "user_name", name="findings")


@query("q40_findings_by_dataset", "SELECT dataset, count(*) AS findings FROM v_logs WHERE kind = 'alert' GROUP BY 1")
def _(spark, sf):
    return d.count_by(logs(spark, sf).filter("kind = 'alert'"), "dataset", name="findings")


@query("q41_control_failures", "SELECT rule_id, count(*) AS failures FROM v_posture WHERE evaluation = 'failed' GROUP BY 1")
def _(spark, sf):
    return d.control_failures(view(spark, sf, "posture"))


@query("q42_eventbridge_failures", """SELECT bucket_name, rule_name, account, region, count(*) AS total_failures,
  count(DISTINCT rule_name) AS rules_affected, CAST(sum(k % 3) AS BIGINT) AS dlq_deliveries, max(k) AS max_targets_failed
  FROM v_logs WHERE outcome = 'failure' GROUP BY 1, 2, 3, 4
  ORDER BY total_failures DESC, bucket_name NULLS LAST, rule_name NULLS LAST, account NULLS LAST, region NULLS LAST LIMIT 5""")
def _(spark, sf):
    df = logs(spark, sf).withColumns({"dead_letters": F.col("k") % 3, "targets_failed": F.col("k")})
    return d.eventbridge_failures(df, ["bucket_name", "rule_name", "account", "region"])


@query("q43_domain_stats", """SELECT qname, count(*) AS total_queries, count(DISTINCT src_ip) AS unique_src_ips, min(ts) AS first_seen,
  max(ts) AS last_seen, count(*) FILTER (WHERE rcode = 'NXDOMAIN') AS nxdomain_count FROM v_logs GROUP BY qname""")
def _(spark, sf):
    return d.domain_stats(logs(spark, sf))


@query("q44_src_ip_breadth", """SELECT src_ip, count(DISTINCT qname) AS domains_queried, count(*) AS total_requests
  FROM v_logs GROUP BY src_ip""")
def _(spark, sf):
    return d.src_ip_breadth(logs(spark, sf))


@query("q45_o365_daily_counts", """SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS report_day, o_orderstatus AS service,
  CAST(sum(o_custkey) AS BIGINT) AS active, CAST(sum(o_orderkey) AS BIGINT) AS inactive FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    report = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_day"), F.col("o_orderstatus").alias("service"),
        F.col("o_custkey").cast("string").alias("active"), F.col("o_orderkey").cast("string").alias("inactive"),
    )
    return d.daily_text_counts(report, ["active", "inactive"], ["service"])


@query("q46_transaction_profile", f"""SELECT service, name, count(*) AS transactions, {rnd('avg(duration_us)')} AS mean_us FROM v_spans
  WHERE kind = 'transaction' GROUP BY 1, 2""")
def _(spark, sf):
    aggs = {"transactions": F.count("*"), "mean_us": F.round(F.avg("duration_us"), 2)}
    return d.aggregate_by(view(spark, sf, "spans"), ["service", "name"], aggs, where=F.col("kind") == "transaction")


@query("q47_span_type_breakdown", "SELECT type, subtype, count(*) AS spans FROM v_spans WHERE kind = 'span' GROUP BY 1, 2")
def _(spark, sf):
    return d.count_by(view(spark, sf, "spans").filter("kind = 'span'"), "type", "subtype", name="spans")


@query("q48_renamed_projection", """SELECT ts AS event_time, user_name AS actor, action AS api_call, src_ip AS origin FROM v_logs
  WHERE action = 'CreateAccessKey' ORDER BY ts DESC, id LIMIT 100""")
def _(spark, sf):
    keep = [F.col("ts").alias("event_time"), F.col("user_name").alias("actor"), F.col("action").alias("api_call"), F.col("src_ip").alias("origin")]
    return d.recent_events(logs(spark, sf), keep, 100, where=F.col("action") == "CreateAccessKey")


@query("q49_principal_activity", """SELECT ts, action, src_ip, bytes FROM v_logs
  WHERE user_name = 'user-8' AND action IN ('GetObject', 'ListUsers')""")
def _(spark, sf):
    return d.principal_activity(logs(spark, sf), "user-8", ["GetObject", "ListUsers"], AS_OF, HOURS)


@query("q50_metric_variant_coalesce", f"""WITH s AS (SELECT host, metric, {tb('1 hour')} AS bucket,
    CASE service_key WHEN 'app_service' THEN 1 ELSE 2 END AS r, sum(amount) AS total FROM v_metric_points GROUP BY 1, 2, 3, 4)
  SELECT host, metric, bucket, CAST(arg_min(total, r) AS BIGINT) AS total FROM s GROUP BY 1, 2, 3""")
def _(spark, sf):
    from skyledger.functions.timebucket import bucket

    points = view(spark, sf, "metric_points").withColumn("bucket", bucket("ts", "1 hour"))
    return d.metric_variant_coalesce(points, ["app_service", "app-service"], ["host", "metric", "bucket"])


@query("q51_metric_sum_or_avg", f"""SELECT dataset, metric,
  CASE WHEN metric IN ('request/error_count', 'read_bytes', 'messages') THEN 'sum' ELSE 'avg' END AS stat,
  CASE WHEN metric IN ('request/error_count', 'read_bytes', 'messages') THEN {rnd('sum(amount)')} ELSE {rnd('avg(amount)')} END AS shown
  FROM v_metric_points GROUP BY dataset, metric""")
def _(spark, sf):
    return d.metric_sum_or_avg(view(spark, sf, "metric_points"), ["dataset"])
