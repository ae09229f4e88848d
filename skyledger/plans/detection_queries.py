"""Registered detection rules over the whole provided tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from skyledger.operators import detections as d
from skyledger.plans.adapters import view
from skyledger.plans.dashboard_queries import logs, tb
from skyledger.plans.registry import query

KEEP = ["id", "ts", "user_name", "src_ip", "host"]
NETWORKS = ["10.0.0.0/23", "10.0.4.0/24"]

# Names of the registered rule queries.
SLUGS = {
    "D01": "failed_run_rate", "D02": "empty_result", "D03": "processing_error", "D04": "source_file_format", "D05": "slow_run",
    "D06": "suspicious_domain", "D07": "dns_firewall_block", "D08": "nxdomain_rate", "D09": "unique_domains",
    "D12": "key_for_another_user", "D13": "non_admin_key", "D14": "admin_policy", "D15": "assume_role_tactic",
    "D16": "user_enumeration", "D17": "no_mfa", "D18": "iam_changes_one_ip", "D19": "iam_volume", "D20": "high_finding",
    "D21": "multi_detector_burst", "D22": "compliance_failed", "D23": "findings_with_ip", "D24": "crypto_mining",
    "D25": "ocsf_finding", "D26": "root_activity", "D27": "trail_stopped", "D29": "exfiltration_finding", "D30": "high_egress",
    "D31": "bulk_get_object", "D32": "get_object_burst", "D33": "waf_block_spike",
}

# The provided events are sparse: rules that count one host or address run over a day here.
WINDOWS = {
    "D01": "1 day", "D05": "1 day", "D22": "7 days", "D08": "1 day", "D09": "1 day", "D18": "1 day", "D19": "1 day", "D21": "7 days", "D23": "7 days", "D32": "7 days", "D33": "7 days",
}

# Conditions of the oracle, written from the rule descriptions.
WHERE = {
    "D01": "event_type = 'error'",
    "D02": "rows_returned < 1",
    "D03": "coalesce(error_type, '') <> ''",
    "D04": "NOT ends_with(object_key, '.avro') OR contains(object_key, '%')",
    "D05": "duration_ms / 1000.0 > 60",
    "D06": "regexp_matches(qname, '(duckdns[.]org|ngrok[.]io|serveo[.]net|[.]xyz)$')",
    "D07": "rule_category IN ('dns_firewall')",
    "D08": "event_type = 'error'",
    "D09": "TRUE",
    "D12": "action = 'CreateAccessKey' AND NOT (user_name = target_user)",
    "D13": "action = 'CreateAccessKey' AND NOT contains(user_name, 'admin')",
    "D14": "action = 'AttachUserPolicy' AND contains(message, 'AdministratorAccess') AND NOT contains(user_name, 'admin')",
    "D15": "action = 'AssumeRole' AND k % 4 < 3",
    "D16": "action = 'ListUsers' AND NOT regexp_matches(user_name, 'admin|service')",
    "D17": "(action = 'CreateAccessKey' OR action = 'AttachUserPolicy' OR action = 'AssumeRole') AND k % 10 = 7",
    "D18": "(action = 'CreateAccessKey' OR action = 'AttachUserPolicy' OR action = 'AssumeRole')",
    "D19": "(action = 'CreateAccessKey' OR action = 'AttachUserPolicy' OR action = 'AssumeRole')",
    "D20": "coalesce(severity_num, 0) >= 7 OR coalesce(severity, '') = 'High' OR coalesce(severity, '') = 'Critical'",
    "D21": "kind = 'alert'",
    "D22": "rule_category = 'posture'",
    "D23": "kind = 'alert'",
    "D24": "regexp_matches(message, 'CryptoCurrency|BitcoinTool|crypto')",
    "D25": "coalesce(severity_num, 0) >= 7 OR event_type IN ('error', 'purchase')",
    "D26": "k % 10 = 4",
    "D27": "k BETWEEN 11 AND 14",
    "D29": "starts_with(finding_type, 'Exfiltration')",
    "D30": "k % 2 = 0 AND bytes > 50 * 1024 * 1024",
    "D31": "action = 'GetObject' AND k > 50",
    "D32": "action = 'GetObject'",
    "D33": "event_type = 'error'",
}

# Streams of the oracle, written from the rule descriptions; the other rules read all streams.
SCOPE = {
    "D01": "stream IN ('aws.mwaa', 'gcp.composer', 'azure.datafactory')",
    "D02": "stream IN ('aws.athena', 'gcp.bigquery', 'azure.synapse')",
    "D03": "stream IN ('aws.emr', 'gcp.dataproc', 'azure.databricks')",
    "D04": "stream IN ('aws.s3access', 'gcp.gcs', 'azure.blobstorage')",
    "D05": "stream IN ('aws.mwaa', 'gcp.composer', 'azure.datafactory')",
    "D20": "stream = 'aws.guardduty'",
    "D21": "stream IN ('aws.guardduty', 'aws.securityhub_findings', 'aws.securitylake')",
    "D22": "stream LIKE 'aws.securityhub%'",
    "D23": "stream = 'aws.guardduty'",
    "D24": "stream = 'aws.guardduty'",
    "D25": "stream = 'aws.securitylake'",
    "D26": "stream = 'aws.cloudtrail'",
    "D29": "stream = 'aws.guardduty'",
    "D33": "stream = 'aws.waf'",
}
WHERE = {rule: f"({SCOPE[rule]}) AND ({where})" if rule in SCOPE else where for rule, where in WHERE.items()}


def rule_logs(spark, sf):
    """Log rows with the stream that rules scope by as their dataset."""
    rows = view(spark, sf, "rule_logs")
    return rows.withColumn("dataset", F.col("stream")).drop("stream")


def _meta(rule: d.Rule) -> str:
    technique = f"'{rule.technique}'" if rule.technique else "CAST(NULL AS VARCHAR)"
    return f"""'{rule.id}' AS rule_id, '{rule.name}' AS rule_name, '{rule.severity}' AS severity,
  CAST({rule.risk} AS INTEGER) AS risk, {technique} AS technique"""


def _threshold_sql(rule: d.Rule) -> str:
    keys = "".join(f", {k}" for k in rule.keys)
    distinct = f", count(DISTINCT {rule.distinct}) AS distinct_values" if rule.distinct else ""
    having = f" AND count(DISTINCT {rule.distinct}) >= {rule.min_distinct}" if rule.distinct else ""
    return f"""SELECT {tb(rule.window)} AS window_start{keys}, count(*) AS hits{distinct}, {_meta(rule)}
  FROM v_rule_logs WHERE {WHERE[rule.id]} GROUP BY {tb(rule.window)}{keys} HAVING count(*) >= {rule.min_count}{having}"""


def _register(rule: d.Rule) -> None:
    name = f"{rule.id.lower()}_{SLUGS[rule.id]}"
    if rule.per_row:
        sql = f"SELECT {', '.join(KEEP)}, {_meta(rule)} FROM v_rule_logs WHERE {WHERE[rule.id]}"
        query(name, sql)(lambda spark, sf: d.query_rule(rule_logs(spark, sf), rule, KEEP))
    else:
        wide = replace(rule, window=WINDOWS.get(rule.id, rule.window))
        query(name, _threshold_sql(wide))(lambda spark, sf: d.threshold_rule(rule_logs(spark, sf), wide))


for _rule in d.RULES:
    _register(_rule)


def _all_rules_sql() -> str:
    parts = []
    for r in d.RULES:
        entity = " || '|' || ".join(f"coalesce({k}, '-')" for k in r.keys) or "'*'"
        value = f"count(DISTINCT {r.distinct})" if r.distinct else "0"
        parts.append(
            f"""SELECT {_meta(r)}, {entity} AS entity, {tb(r.window)} AS window_start, count(*) AS hits, {value} AS distinct_values
  FROM v_rule_logs WHERE {WHERE[r.id]} GROUP BY {entity}, {tb(r.window)}
  HAVING count(*) >= {r.min_count} AND {value} >= {r.min_distinct}""" if r.keys else
            f"""SELECT {_meta(r)}, '*' AS entity, {tb(r.window)} AS window_start, count(*) AS hits, {value} AS distinct_values
  FROM v_rule_logs WHERE {WHERE[r.id]} GROUP BY {tb(r.window)} HAVING count(*) >= {r.min_count} AND {value} >= {r.min_distinct}"""
        )
    return "\nUNION ALL\n".join(parts)


@query("d00_all_rules_one_pass", _all_rules_sql())
def _(spark, sf):
    return d.run_rules(rule_logs(spark, sf))


@query("d00_sliding_threshold", f"""WITH s AS (SELECT unnest([0, 8, 16]) AS back),
  w AS (SELECT time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01') - to_hours(back) AS window_start
    FROM v_rule_logs, s WHERE {WHERE["D01"]})
  SELECT window_start, count(*) AS hits, 'D01' AS rule_id, 'Data run failure rate' AS rule_name, 'medium' AS severity,
    CAST(47 AS INTEGER) AS risk, CAST(NULL AS VARCHAR) AS technique FROM w GROUP BY window_start HAVING count(*) >= 4""")
def _(spark, sf):
    return d.threshold_rule(rule_logs(spark, sf), d.RULE_BY_ID["D01"], window="1 day", slide="8 hours")


@query("d10_dns_tunnelling", f"""SELECT {tb('1 day')} AS window_start, host, regexp_extract(qname, '([^.]+[.][^.]+)$', 1) AS parent,
  count(DISTINCT qname) AS unique_subdomains, count(*) AS total FROM v_logs
  WHERE length(qname) - length(replace(qname, '.', '')) > 1 GROUP BY 1, 2, 3 HAVING count(DISTINCT qname) > 2""")
def _(spark, sf):
    return d.dns_tunnelling(logs(spark, sf), "1 day", min_distinct=3)


@query("d11_resolved_before_block", """SELECT b.host, b.qname, min(r.ts) AS first_resolved, max(b.ts) AS last_blocked, count(DISTINCT b.id) AS blocks
  FROM v_logs b JOIN v_logs r ON b.host = r.host AND b.qname = r.qname AND r.rcode = 'NOERROR'
  WHERE b.rule_category = 'dns_firewall' GROUP BY 1, 2 HAVING min(r.ts) < max(b.ts)""")
def _(spark, sf):
    return d.resolved_before_block(logs(spark, sf))


@query("d15_admin_role_from_outside", """SELECT id, ts, user_name, src_ip, host FROM v_logs
  WHERE action = 'AssumeRole' AND message LIKE '%AdminRole%' AND user_id % 8 NOT IN (0, 1, 4)""")
def _(spark, sf):
    return d.admin_role_from_outside(logs(spark, sf), NETWORKS, KEEP)


@query("d28_log_gap", f"""WITH b AS (SELECT DISTINCT dataset, {tb('5 minutes')} AS bucket FROM v_logs),
  g AS (SELECT dataset, bucket AS prev, coalesce(lead(bucket) OVER (PARTITION BY dataset ORDER BY bucket), TIMESTAMP '2024-02-01 00:00:00') AS bucket FROM b)
  SELECT dataset, prev + INTERVAL '5 minutes' AS gap_start, bucket AS gap_end,
    CAST(date_diff('minute', prev, bucket) / 5 - 1 AS BIGINT) AS missing_buckets FROM g WHERE bucket > prev + INTERVAL '5 minutes'""")
def _(spark, sf):
    return d.log_gaps(logs(spark, sf), ["dataset"], as_of="2024-02-01 00:00:00")


SIGNALS = {
    "finding": "finding_type LIKE 'Exfiltration%'",
    "egress": "direction = 'egress' AND bytes > 52428800",
    "reads": "action = 'GetObject' AND additional_count > 100",
}


@query("d34_full_chain", f"""WITH s AS (
    SELECT ts, 1 AS signal FROM v_logs WHERE finding_type LIKE 'Exfil%' UNION ALL
    SELECT ts, 2 FROM v_logs WHERE direction = 'egress' AND bytes > 52428800 UNION ALL
    SELECT ts, 3 FROM v_logs WHERE action = 'GetObject' AND additional_count > 100)
  SELECT {tb('1 hour')} AS window_start, count(DISTINCT signal) AS signals, count(*) AS "rows" FROM s GROUP BY 1 HAVING count(DISTINCT signal) = 3""")
def _(spark, sf):
    return d.full_chain(logs(spark, sf), SIGNALS, "1 hour")


@query("d35_beaconing", """WITH g AS (SELECT host, qname,
    (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY host, qname ORDER BY ts, id)) / 1000000.0 AS gap FROM v_logs)
  SELECT host, qname, count(gap) AS gaps, round(avg(gap), 3) AS mean_gap, round(stddev_samp(gap), 3) AS sd_gap,
    coalesce(count(gap) >= 3 AND stddev_samp(gap) / avg(gap) <= 0.9
      AND (abs(avg(gap) - 3600) <= 360 OR abs(avg(gap) - 7200) <= 720 OR abs(avg(gap) - 14400) <= 1440), FALSE) AS beacon
  FROM g GROUP BY 1, 2 HAVING count(gap) > 0""")
def _(spark, sf):
    out = d.beaconing(logs(spark, sf), max_cv=0.9, periods=(3600, 7200, 14400))
    return out.withColumns({"mean_gap": F.round("mean_gap", 3), "sd_gap": F.round("sd_gap", 3)})


@query("d36_rule_metadata", """SELECT l.id, l.rule_id, m.name AS rule_name, m.severity, CAST(m.risk AS INTEGER) AS risk, m.technique, m.chain
  FROM (SELECT id, CASE k % 3 WHEN 0 THEN 'D06' WHEN 1 THEN 'D14' ELSE 'D99' END AS rule_id FROM v_logs) l
  LEFT JOIN (VALUES ('D06', 'DNS query to suspicious domain', 'high', 73, 'T1071.004', 'dns'),
    ('D14', 'Administrator policy attached', 'critical', 99, 'T1078.004', 'iam')) m(rule_id, name, severity, risk, technique, chain)
  ON l.rule_id = m.rule_id""")
def _(spark, sf):
    rule = F.when(F.col("k") % 3 == 0, "D06").when(F.col("k") % 3 == 1, "D14").otherwise("D99")
    return d.attach_rule_metadata(logs(spark, sf).select("id", rule.alias("rule_id"))).drop("techniques", "tactics")


@query("d36_tactics_and_techniques", """WITH m AS (SELECT * FROM (VALUES ('D06', 'T1071.004', 'Command and Control'), ('D06', 'T1048.003', 'Exfiltration'), ('D09', 'T1595.002', 'Reconnaissance'),
    ('D09', 'T1048.003', 'Exfiltration'), ('D14', 'T1078.004', 'Privilege Escalation')) v(rule_id, technique, tactic)),
  l AS (SELECT id, host, CASE k % 4 WHEN 0 THEN 'D06' WHEN 1 THEN 'D09' WHEN 2 THEN 'D14' ELSE 'D01' END AS rule_id FROM v_logs)
  SELECT host, tactic, count(DISTINCT technique) AS techniques, count(DISTINCT id) AS hits FROM l JOIN m ON l.rule_id = m.rule_id GROUP BY 1, 2""")
def _(spark, sf):
    """Hits and techniques per host and tactic; a rule counts under each of its tactics."""
    rule = F.when(F.col("k") % 4 == 0, "D06").when(F.col("k") % 4 == 1, "D09").when(F.col("k") % 4 == 2, "D14").otherwise("D01")
    hits = d.attach_rule_metadata(logs(spark, sf).select("id", "host", rule.alias("rule_id")))
    return d.tactic_coverage(hits, ["host"])


@query("d37_suppressed_alerts", """SELECT a.id, a.ts, a.rule, a.host FROM v_alerts a
  WHERE NOT EXISTS (SELECT 1 FROM v_tickets t WHERE t.kind = 'change_request' AND t.priority = '5-LOW' AND t.host = a.host
    AND a.ts >= t.ts AND a.ts < t.ts + INTERVAL '30 minutes')""")
def _(spark, sf):
    mutes = view(spark, sf, "tickets").filter("kind = 'change_request' AND priority = '5-LOW'")
    mutes = mutes.select("host", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("end_ts"))
    return d.suppress(view(spark, sf, "alerts"), mutes, ["host"]).select("id", "ts", "rule", "host")


@query("d38_dga_hosts", """WITH n AS (SELECT DISTINCT qname, split_part(qname, '.', 1) AS label FROM v_logs),
  f AS (SELECT qname FROM n WHERE length(label) >= 8 AND length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label) >= 0.15
    AND list_entropy(string_split(label, '')) >= 2.5)
  SELECT host, count(*) FILTER (WHERE rcode = 'NXDOMAIN') AS failed_random, min(ts) FILTER (WHERE rcode = 'NXDOMAIN') AS first_failed,
    max(ts) FILTER (WHERE rcode = 'NOERROR') AS last_resolved
  FROM v_logs WHERE qname IN (SELECT qname FROM f) GROUP BY host
  HAVING failed_random >= 5 AND last_resolved > first_failed""")
def _(spark, sf):
    return d.dga_hosts(logs(spark, sf))


@query("d39_failed_deliveries", f"""SELECT {tb('30 minutes')} AS window_start, bucket_name,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN k % 9 = 0 THEN k ELSE 0 END) AS BIGINT) AS dead_letters
  FROM v_logs GROUP BY 1, 2 HAVING sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 OR sum(CASE WHEN k % 9 = 0 THEN k ELSE 0 END) > 0""")
def _(spark, sf):
    sums = {
        "failed": F.when(F.col("outcome") == "failure", 1).otherwise(0),
        "dead_letters": F.when(F.col("k") % 9 == 0, F.col("k")).otherwise(0),
    }
    return d.sum_threshold(logs(spark, sf), ["bucket_name"], sums)


@query("d10_payload_lookups", """SELECT id, ts, qname, qtype, answers FROM v_dns WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'
  AND regexp_matches(qname, '(^|[.])(duckdns[.]org|evil1[.]com)$') AND (qtype = 'TXT' OR qtype = 'CNAME')""")
def _(spark, sf):
    """TXT and CNAME look-ups of a week below two parent domains."""
    return d.payload_lookups(view(spark, sf, "dns"), ["duckdns.org", "Evil1.com"], "2024-01-15 00:00:00", "7 DAYS", keep=("id", "ts", "qname", "qtype", "answers"))
