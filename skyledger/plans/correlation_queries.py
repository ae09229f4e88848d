"""Registered alert enrichment and correlation queries over the whole provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import correlation as c
from skyledger.plans.adapters import table, view
from skyledger.plans.dashboard_queries import logs
from skyledger.plans.registry import query


def v(spark, sf, name):
    return view(spark, sf, name)


PRIV = "('ListUsers', 'CreateAccessKey', 'AttachUserPolicy', 'AssumeRole')"
SOURCE_CTE = f"""src AS (SELECT a.id, e.ts AS attack_ts, e.src_ip AS attack_src_ip, e.user_name AS attack_user_name, e.action AS attack_action,
    row_number() OVER (PARTITION BY a.id ORDER BY e.ts DESC, e.id DESC) AS rn
  FROM v_alerts a JOIN v_logs e ON e.host = a.host AND e.ts <= a.ts AND e.ts >= a.ts - INTERVAL '1 hour'
    AND (e.action IN {PRIV} OR e.session IS NOT NULL))"""
CI_CTE = """ci AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, ci_id DESC) AS rn FROM v_ci
  WHERE category IN ('Compute', 'Security', 'Cloud Service', 'Identity'))"""
OPEN_SQL = """(SELECT count(*) FROM v_tickets t WHERE t.kind = 'incident' AND t.state = 'In Progress' AND t.host = a.host
  AND t.ts <= a.ts AND t.ts >= a.ts - INTERVAL '7 days')"""
CHANGES_SQL = """(SELECT count(*) FROM v_tickets t WHERE t.kind = 'change_request' AND t.host = a.host
  AND t.ts <= a.ts AND t.ts >= a.ts - INTERVAL '7 days')"""
RELATED_SQL = """(SELECT count(*) FROM v_alerts r WHERE r.tag = 'Attack Discovery' AND r.ts <= a.ts AND r.ts >= a.ts - INTERVAL '1 hour')"""


@query("j01_attack_source", f"""WITH {SOURCE_CTE} SELECT a.id, a.ts, attack_ts, attack_src_ip, attack_user_name, attack_action
  FROM v_alerts a LEFT JOIN src ON src.id = a.id AND rn = 1""")
def _(spark, sf):
    out = c.attack_source(v(spark, sf, "alerts"), logs(spark, sf))
    return out.select("id", "ts", "attack_ts", "attack_src_ip", "attack_user_name", "attack_action")


@query("j02_affected_ci", f"""WITH {CI_CTE} SELECT a.id, a.host, CAST(ci.rn AS INTEGER) AS rank, ci.ci_id, ci.name AS ci_name, ci.owner AS ci_owner FROM v_alerts a LEFT JOIN ci ON ci.host = a.host AND rn <= 3""")
def _(spark, sf):
    return c.affected_ci(v(spark, sf, "alerts"), v(spark, sf, "ci")).select("id", "host", "rank", "ci_id", "ci_name", "ci_owner")


@query("j03_target_user", "SELECT a.id, a.user_name, s.full_name, s.email, s.manager FROM v_alerts a LEFT JOIN v_staff s ON s.user_name = a.user_name")
def _(spark, sf):
    return c.target_user(v(spark, sf, "alerts"), v(spark, sf, "staff")).select("id", "user_name", "full_name", "email", "manager")


@query("j04_open_incidents", f"SELECT a.id, a.host, {OPEN_SQL} AS open_incident_count FROM v_alerts a")
def _(spark, sf):
    return c.open_incidents(v(spark, sf, "alerts"), v(spark, sf, "tickets")).select("id", "host", "open_incident_count")


@query("j05_recent_changes", f"""WITH l AS (SELECT a.id, t.id AS change_id, t.priority, t.ts, row_number() OVER (PARTITION BY a.id ORDER BY t.ts DESC, t.id DESC) AS rn
    FROM v_alerts a JOIN v_tickets t ON t.kind = 'change_request' AND t.host = a.host AND t.ts <= a.ts AND t.ts >= a.ts - INTERVAL '7 days')
  SELECT a.id, {CHANGES_SQL} AS change_count, l.change_id AS latest_change_id, l.priority AS latest_priority, l.ts AS latest_ts
  FROM v_alerts a LEFT JOIN l ON l.id = a.id AND rn = 1""")
def _(spark, sf):
    out = c.recent_changes(v(spark, sf, "alerts"), v(spark, sf, "tickets"))
    return out.select("id", "change_count", "latest_change_id", "latest_priority", "latest_ts")


@query("j06_related_alert_count", f"SELECT a.id, {RELATED_SQL} AS related_alert_count FROM v_alerts a")
def _(spark, sf):
    return c.related_alert_count(v(spark, sf, "alerts")).select("id", "related_alert_count")


@query("j07_related_alerts", """WITH p AS (SELECT a.id, a.src_ip, r.id AS related_id, r.rule AS related_rule, r.severity AS related_severity, r.ts AS related_ts,
    row_number() OVER (PARTITION BY a.id ORDER BY r.ts DESC, r.id DESC) AS rank
    FROM v_alerts a JOIN v_alerts r ON r.src_ip = a.src_ip AND r.id <> a.id AND (r.ts < a.ts OR (r.ts = a.ts AND r.id < a.id)) AND r.ts >= a.ts - INTERVAL '7 days')
  SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM p WHERE rank <= 10""")
def _(spark, sf):
    return c.related_alerts(v(spark, sf, "alerts"))


@query("j08_enriched_alert", f"""WITH {SOURCE_CTE}, {CI_CTE}
  SELECT a.id, a.rule, attack_src_ip, attack_user_name, ci.name AS ci_name, s.email, {OPEN_SQL} AS open_incident_count, {CHANGES_SQL} AS change_count,
    {RELATED_SQL} AS related_alert_count
  FROM v_alerts a LEFT JOIN src ON src.id = a.id AND src.rn = 1 LEFT JOIN ci ON ci.host = a.host AND ci.rn = 1 LEFT JOIN v_staff s ON s.user_name = a.user_name""")
def _(spark, sf):
    out = c.enrich_alert(v(spark, sf, "alerts"), logs(spark, sf), v(spark, sf, "ci"), v(spark, sf, "staff"), v(spark, sf, "tickets"))
    return out.select("id", "rule", "attack_src_ip", "attack_user_name", "ci_name", "email", "open_incident_count", "change_count", "related_alert_count")


@query("j09_run_alert_enrich", """WITH src AS (SELECT a.id, e.user_name, row_number() OVER (PARTITION BY a.id ORDER BY e.ts DESC, e.id DESC) AS rn
    FROM v_alerts a JOIN v_logs e ON e.dag_id = a.dag_id AND e.dataset = 'gcp.composer' AND e.ts <= a.ts AND e.ts >= a.ts - INTERVAL '1 hour'),
  ci AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY ts DESC, ci_id DESC) AS rn FROM v_ci WHERE category <> 'Furniture')
  SELECT a.id, a.dag_id, src.user_name, s.email, ci.ci_id, ci.owner AS ci_owner FROM v_alerts a LEFT JOIN src ON src.id = a.id AND src.rn = 1
  LEFT JOIN v_staff s ON s.user_name = src.user_name LEFT JOIN ci ON ci.resource = a.dag_id AND ci.rn = 1""")
def _(spark, sf):
    out = c.run_alert_enrich(v(spark, sf, "alerts"), logs(spark, sf), v(spark, sf, "ci"), v(spark, sf, "staff"))
    return out.select("id", "dag_id", "user_name", "email", "ci_id", "ci_owner")


@query("j10_ci_by_any_name", """WITH a AS (SELECT id, 'Customer#' || lpad(CAST(k AS VARCHAR), 9, '0') AS rule_ci, CASE WHEN k % 3 = 0 THEN dag_id END AS bus FROM v_logs),
  n AS (SELECT name, max(struct_pack(ts := ts, ci_id := ci_id)) AS hit FROM v_ci GROUP BY 1), b AS (SELECT resource, max(struct_pack(ts := ts, ci_id := ci_id)) AS hit FROM v_ci GROUP BY 1),
  t AS (SELECT max(struct_pack(ts := ts, ci_id := ci_id)) AS hit FROM v_ci WHERE short_description LIKE '%eventbridge%'),
  h AS (SELECT a.id, list_max(list_filter([n.hit, b.hit, (SELECT hit FROM t)], lambda x: x IS NOT NULL)) AS hit FROM a LEFT JOIN n ON n.name = a.rule_ci LEFT JOIN b ON b.resource = a.bus)
  SELECT id, hit.ci_id AS ci_id, hit.ts AS ci_ts FROM h""")
def _(spark, sf):
    a = logs(spark, sf).select(
        "id", F.concat(F.lit("Customer#"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("rule_ci"), F.when(F.col("k") % 3 == 0, F.col("dag_id")).alias("bus")
    )
    return c.ci_by_any_name(a, v(spark, sf, "ci"), "rule_ci", "bus", "EventBridge").select("id", "ci_id", "ci_ts")


EDGE_SQL = """e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
  UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


def edges(spark, sf):
    """Asset relations: region, nation, customer, order and supplier, with a cycle between supplier and nation."""
    tag = lambda p, col: F.concat(F.lit(p), F.col(col))
    part = lambda t, p, a, q, b: table(spark, sf, t).select(tag(p, a).alias("parent"), tag(q, b).alias("child"))
    return (
        part("nation", "r", "n_regionkey", "n", "n_nationkey").union(part("customer", "n", "c_nationkey", "c", "c_custkey"))
        .union(part("orders", "c", "o_custkey", "o", "o_orderkey")).union(part("supplier", "n", "s_nationkey", "s", "s_suppkey"))
        .union(part("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    )


@query("j11_ci_impact", f"""WITH RECURSIVE {EDGE_SQL},
  w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS item, 0 AS distance FROM region
    UNION SELECT w.root, e.child, w.distance + 1 FROM w JOIN e ON e.parent = w.item WHERE w.distance < 3),
  m AS (SELECT root, item, min(distance) AS distance FROM w GROUP BY 1, 2)
  SELECT root, item, CAST(distance AS INTEGER) AS distance FROM m WHERE distance > 0""")
def _(spark, sf):
    roots = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("root"))
    return c.ci_impact(edges(spark, sf), roots, 3)


@query("j12_chain_by_label", "SELECT session, row_number() OVER (PARTITION BY session ORDER BY ts, id) AS step, ts, action FROM v_logs WHERE session IS NOT NULL")
def _(spark, sf):
    return c.chain_by_label(logs(spark, sf)).select("session", "step", "ts", "action")


@query("j12_conversation_order", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS step, turn, role FROM conversations")
def _(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("ts", F.timestamp_seconds(F.col("turn") * 60))
    from skyledger.functions.ordered import numbered

    return numbered(rows, ["conv_id"], "ts", ["role", "text"], "step").select("conv_id", "step", "turn", "role")


@query("j13_privesc_sequence", """WITH a AS (SELECT user_name, ts AS t1 FROM v_logs WHERE action = 'ListUsers'),
  b AS (SELECT a.*, (SELECT min(l.ts) FROM v_logs l WHERE l.user_name = a.user_name AND l.action = 'CreateAccessKey' AND l.ts > a.t1) AS t2 FROM a),
  c AS (SELECT b.*, (SELECT min(l.ts) FROM v_logs l WHERE l.user_name = b.user_name AND l.action = 'AttachUserPolicy' AND l.ts > b.t2) AS t3 FROM b),
  d AS (SELECT c.*, (SELECT min(l.ts) FROM v_logs l WHERE l.user_name = c.user_name AND l.action = 'AssumeRole' AND l.ts > c.t3) AS t4 FROM c)
  SELECT * FROM d WHERE t4 <= t1 + INTERVAL '3 days'""")
def _(spark, sf):
    return c.privesc_sequence(logs(spark, sf), 3 * 86400)


@query("j14_exfil_join", """WITH f AS (SELECT id, ts, src_ip, finding_type FROM v_logs WHERE finding_type LIKE 'Exfiltration%'),
  g AS (SELECT f.*, (SELECT count(*) FROM v_logs r WHERE r.action = 'GetObject' AND r.src_ip = f.src_ip AND r.ts BETWEEN f.ts - INTERVAL '6 hours' AND f.ts + INTERVAL '6 hours') AS object_reads,
    (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM v_logs r WHERE r.direction = 'egress' AND r.bytes > 52428800 AND r.src_ip = f.src_ip
      AND r.ts BETWEEN f.ts - INTERVAL '6 hours' AND f.ts + INTERVAL '6 hours') AS egress_bytes FROM f)
  SELECT * FROM g WHERE object_reads > 0 AND egress_bytes > 0""")
def _(spark, sf):
    return c.exfil_join(logs(spark, sf), window_seconds=6 * 3600)


@query("j15_finding_lineage", """WITH li AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS ts FROM lineitem GROUP BY 1, 2)
  SELECT 'd' || o_orderkey AS detector_id, 'h' || h.l_orderkey AS hub_id, 'l' || k.l_orderkey AS lake_id,
    CAST(date_diff('second', o_orderdate, h.ts) AS DOUBLE) AS hub_lag, CAST(date_diff('second', h.ts, k.ts) AS DOUBLE) AS lake_lag
  FROM orders JOIN li h ON h.l_orderkey = o_orderkey AND h.l_linenumber = 1 LEFT JOIN li k ON k.l_orderkey = h.l_orderkey AND k.l_linenumber = 2""")
def _(spark, sf):
    li = v(spark, sf, "stages")
    order = F.substring_index("run_id", "-", -1)
    detector = table(spark, sf, "orders").select(F.concat(F.lit("d"), "o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    hub = li.filter("step = 1").select(F.concat(F.lit("h"), order).alias("id"), "ts", F.array(F.concat(F.lit("d"), order)).alias("related"))
    lake = li.filter("step = 2").select(
        F.concat(F.lit("l"), order).alias("id"), "ts", F.array(F.concat(F.lit("h"), order), F.concat(F.lit("d"), order)).alias("related")
    )
    return c.finding_lineage(detector, hub, lake)


@query("j16_dns_c2_stages", """WITH d AS (SELECT *, date_trunc('day', ts) AS day, coalesce(rule_category = 'dns_firewall', FALSE) AS blocked,
    rcode = 'NOERROR' AND (qname LIKE '%duckdns.org' OR qname LIKE '%.xyz') AS hit FROM v_logs),
  g AS (SELECT host, day, min(ts) FILTER (WHERE rcode = 'NXDOMAIN' AND NOT blocked) AS first_probe, min(ts) FILTER (WHERE hit) AS first_resolved,
    max(ts) FILTER (WHERE hit) AS last_beacon, max(ts) FILTER (WHERE blocked) AS last_block, count(*) FILTER (WHERE hit) AS resolutions FROM d GROUP BY 1, 2)
  SELECT *, coalesce(first_probe < first_resolved AND first_resolved < last_beacon AND last_beacon < last_block, FALSE) AS complete FROM g""")
def _(spark, sf):
    dns = logs(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    return c.dns_c2_stages(dns, c.suspicious_name(), ["host", "day"])


@query("j17_multi_chain_story", """WITH t AS (SELECT host, chain, tactic, min(ts) AS first, count(*) AS n FROM v_alerts GROUP BY 1, 2, 3)
  SELECT host, count(DISTINCT chain) AS chains, CAST(sum(n) AS BIGINT) AS alerts, min(first) AS first_alert, string_agg(tactic, ' > ' ORDER BY first, tactic) AS story
  FROM t GROUP BY host HAVING count(DISTINCT chain) >= 2""")
def _(spark, sf):
    return c.multi_chain_story(v(spark, sf, "alerts"))


@query("j18_mttd_lag", """WITH g AS (SELECT session, min(ts) AS first_signal, min(ts) FILTER (WHERE rule_category = 'dns_firewall') AS first_block
    FROM v_logs WHERE session IS NOT NULL GROUP BY 1)
  SELECT *, date_diff('microsecond', first_signal, first_block) / 1000000.0::DOUBLE AS lag_seconds FROM g WHERE first_block IS NOT NULL""")
def _(spark, sf):
    return c.mttd_lag(logs(spark, sf), F.col("rule_category") == "dns_firewall")


@query("j19_run_rollup", """SELECT run_id, count(*) AS stages, CASE WHEN bool_or(outcome = 'failure') THEN 'failure' ELSE 'success' END AS status,
  min(ts) AS started, max(ts) AS ended, CAST(sum(duration_ms) AS BIGINT) AS busy_ms FROM v_stages GROUP BY run_id""")
def _(spark, sf):
    return c.run_rollup(v(spark, sf, "stages"))


@query("j20_silent_empty_runs", """SELECT s.run_id FROM v_stages s JOIN v_stages q ON q.run_id = s.run_id AND q.stage = 'query' AND q.outcome = 'success' AND q.rows_read = 0
  WHERE s.stage = 'spark' AND s.outcome = 'success' AND s.rows_read = 0""")
def _(spark, sf):
    return c.silent_empty_runs(v(spark, sf, "stages"))


@query("j21_schema_drift_impact", """SELECT c.run_id, c.ts AS drift_ts, q.ts AS failed_ts FROM v_stages c JOIN v_stages q ON q.run_id = c.run_id AND q.stage = 'query'
  AND q.outcome = 'failure' AND q.ts > c.ts WHERE c.stage = 'crawler' AND c.schema_drift""")
def _(spark, sf):
    return c.schema_drift_impact(v(spark, sf, "stages"))
