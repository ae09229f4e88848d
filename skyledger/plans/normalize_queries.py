"""Registered normalisation steps over raw log lines derived from the whole events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import fixed_values as fx
from skyledger.operators import normalize as n
from skyledger.plans.adapters import table, view
from skyledger.plans.dashboard_queries import tb
from skyledger.plans.registry import query


def raw(spark, sf):
    return raw_columns(view(spark, sf, "raw_logs"))


def raw_columns(df):
    """Raw rows under the dotted names the normalisation steps expect."""
    claims = F.when(F.col("upn").isNotNull(), F.create_map(F.lit(fx.UPN_CLAIM), F.col("upn"), F.lit("appid"), F.lit("app")))
    azure, gcp, aws = (F.col("vendor") == v for v in ("azure", "gcp", "aws"))
    return df.select(
        "id", "ts", "k", "user_id", "event_type", "vendor", "dataset", "svc_group", "message",
        F.col("outcome").alias("event.outcome"), F.col("pre_kind").alias("event.kind"), F.col("pre_ip").alias("source.ip"),
        F.when(azure, F.col("caller_ip")).alias("callerIpAddress"), F.when(azure, F.col("operation_name")).alias("operationName"),
        F.when(azure, F.lit("Administrative")).alias("category"), F.when(azure, F.col("envelope_level")).alias("level"),
        F.when(azure, claims).alias("identity.claims"),
        F.when(gcp, F.col("proto")).alias("protoPayload"), F.when(gcp, F.col("envelope_level")).alias("severity"),
        F.when(aws, F.col("caller_ip")).alias("aws.cloudtrail.sourceIPAddress"),
        F.when(aws, F.concat(F.lit("root"), F.col("user_id"))).alias("aws.cloudtrail.userIdentity.userName"),
        F.when(aws, F.col("operation_name")).alias("aws.cloudtrail.eventName"),
        F.when(aws, F.lit("Boto3/1.2")).alias("aws.cloudtrail.userAgent"),
    )


def parsed(spark, sf):
    return n.parse_json(n.preserve_original(raw(spark, sf)))


def show(df, **columns):
    return df.select("id", *[F.col(f"`{c}`").alias(a) for a, c in columns.items()])


def J(key: str) -> str:
    return f"CASE WHEN json_valid(message) THEN json_extract_string(message, '$.{key}') END"


IS_JSON = "k % 9 NOT IN (0, 1, 3, 4, 5)"
HAS_LEVEL = "(CASE k % 3 WHEN 0 THEN 'Warning' WHEN 1 THEN NULL ELSE 'Error' END)"


@query("n01_ecs_version", "SELECT id, '9.3.0' AS version FROM v_raw_logs")
def _(spark, sf):
    return show(n.set_ecs_version(raw(spark, sf).withColumn("ecs.version", F.lit("1.0"))), version="ecs.version")


@query("n02_preserve_original", "SELECT id, CASE WHEN k % 2 = 0 THEN 'kept' ELSE message END AS original FROM v_raw_logs")
def _(spark, sf):
    return show(n.preserve_original(raw(spark, sf).withColumn("event.original", F.when(F.col("k") % 2 == 0, "kept"))), original="event.original")


@query("n03_parse_json", f"""SELECT id, {IS_JSON} AS is_json, {J('job_id')} AS job_id, {J('latency')} AS latency FROM v_raw_logs""")
def _(spark, sf):
    df = parsed(spark, sf)
    return df.select("id", F.col("parsed").isNotNull().alias("is_json"), F.col("parsed")["job_id"].alias("job_id"), F.col("parsed")["latency"].alias("latency"))


@query("n04_rename_first_wins", f"""SELECT id, CASE WHEN k % 7 = 0 THEN 'preset' ELSE coalesce({J('jobId')}, {J('job_id')}) END AS job FROM v_raw_logs""")
def _(spark, sf):
    df = parsed(spark, sf).withColumn("job", F.when(F.col("k") % 7 == 0, "preset"))
    return show(n.rename_first_wins(df, "job", "jobId", "job_id"), job="job")


@query("n05_grok_log4j", """SELECT id, CASE WHEN svc_group IN ('analytics', 'compute', 'ml', 'serverless')
  THEN CASE k % 9 WHEN 0 THEN 'ERROR' WHEN 4 THEN 'WARN' END END AS level FROM v_raw_logs""")
def _(spark, sf):
    return show(n.grok_log4j_fallback(parsed(spark, sf)), level="log.level")


@query("n06_grok_lambda_report", """SELECT id, CASE WHEN k % 9 IN (1, 5) THEN md5(CAST(id AS VARCHAR)) END AS request_id,
  CASE WHEN k % 9 = 1 THEN k + 0.5 END::DOUBLE AS duration, CASE WHEN k % 9 = 1 THEN k + 1 END::DOUBLE AS billed,
  CASE WHEN k % 9 = 1 THEN 512 END::INTEGER AS memory, CASE WHEN k % 9 = 1 THEN k END::INTEGER AS used,
  CASE WHEN k % 9 = 5 THEN '$LATEST' END AS version FROM v_raw_logs""")
def _(spark, sf):
    return show(
        n.grok_lambda_report(parsed(spark, sf)), request_id="lambda.request_id", duration="lambda.duration_ms", billed="lambda.billed_duration_ms",
        memory="lambda.memory_size_mb", used="lambda.max_memory_used_mb", version="lambda.version",
    )


@query("n07_lambda_billed_duration", "SELECT id, CASE WHEN k % 9 = 1 THEN (k + 1) * 1000000 END AS duration FROM v_raw_logs")
def _(spark, sf):
    return show(n.lambda_billed_duration(n.grok_lambda_report(parsed(spark, sf))), duration="event.duration")


@query("n08_lambda_memory_pct", "SELECT id, CASE WHEN k % 9 = 1 THEN floor(k * 10000.0::DOUBLE / 512 + 0.5) / 100.0::DOUBLE END AS pct FROM v_raw_logs")
def _(spark, sf):
    return show(n.lambda_memory_pct(n.grok_lambda_report(parsed(spark, sf))), pct="lambda.memory_utilization_pct")


@query("n09_athena_extract", f"""SELECT id, {J('queryId')} AS query_id, {J('workgroup')} AS workgroup, {J('state')} AS state,
  CASE WHEN {IS_JSON} THEN (k % 4) * 1000000000 END AS duration FROM v_raw_logs""")
def _(spark, sf):
    df = n.athena_extract(parsed(spark, sf))
    part = lambda c: F.try_element_at("fields", F.lit(c)).alias(c)
    return df.select("id", part("query_id"), part("workgroup"), part("state"), F.col("`event.duration`").alias("duration"))


@query("n10_identity_azure", f"""SELECT id, CASE WHEN vendor = 'azure' THEN upn END AS email,
  coalesce(pre_ip, CASE WHEN vendor = 'azure' THEN caller_ip END) AS ip, CASE WHEN vendor = 'azure' THEN operation_name END AS action,
  CASE WHEN vendor = 'azure' THEN 'Administrative' END AS category, CASE WHEN vendor = 'azure' THEN {HAS_LEVEL} END AS level FROM v_raw_logs""")
def _(spark, sf):
    return show(n.identity_azure(parsed(spark, sf)), email="user.email", ip="source.ip", action="event.action", category="azure.log.category", level="log.level")


@query("n11_identity_gcp", f"""SELECT id, CASE WHEN {IS_JSON} AND k % 2 = 0 THEN 'in' || user_id || '@x.io' WHEN vendor = 'gcp' THEN 'out@x.io' END AS email,
  coalesce(pre_ip, CASE WHEN {IS_JSON} AND k % 2 = 0 THEN '10.1.0.1' WHEN vendor = 'gcp' THEN '10.1.0.2' END) AS ip,
  CASE WHEN {IS_JSON} AND k % 2 = 0 THEN 'm.inner' WHEN vendor = 'gcp' THEN 'm.outer' END AS action,
  CASE WHEN vendor = 'gcp' THEN {HAS_LEVEL} END AS level FROM v_raw_logs""")
def _(spark, sf):
    return show(n.identity_gcp(parsed(spark, sf)), email="user.email", ip="source.ip", action="event.action", level="log.level")


@query("n12_identity_aws", """SELECT id, coalesce(pre_ip, CASE WHEN vendor = 'aws' THEN caller_ip END) AS ip,
  CASE WHEN vendor = 'aws' THEN 'root' || user_id END AS name, CASE WHEN vendor = 'aws' THEN operation_name END AS action,
  CASE WHEN vendor = 'aws' THEN 'Boto3/1.2' END AS agent FROM v_raw_logs""")
def _(spark, sf):
    return show(n.identity_aws(parsed(spark, sf)), ip="source.ip", name="user.name", action="event.action", agent="user_agent.original")


@query("n13_group_extract", f"""WITH p AS (SELECT *, svc_group AS g, CASE WHEN json_valid(message) THEN message::JSON END AS j FROM v_raw_logs)
  SELECT id,
  CASE WHEN g IN ('analytics', 'datawarehouse', 'data-ai') THEN coalesce(j->>'jobId', j->>'job_id') WHEN g = 'media' THEN j->>'job_id' END AS job_id,
  CASE WHEN g IN ('security', 'networking', 'iot', 'management', 'enduser') THEN j->>'action' END AS action,
  CASE WHEN g = 'security' THEN j->>'finding_type' END AS rule_name,
  CASE WHEN g IN ('security', 'networking') THEN j->>'rule_id' END AS rule_id,
  CASE WHEN g = 'security' THEN j->>'severity' END AS severity,
  CASE WHEN g = 'compute' THEN j->>'instance_id' END AS host_id,
  CASE WHEN g = 'databases' THEN j->>'db_instance' END AS instance,
  coalesce(pre_ip, CASE WHEN g = 'networking' THEN j->>'src_addr' END) AS src_ip,
  CASE WHEN g = 'networking' THEN CAST(j->>'src_port' AS BIGINT) END AS src_port,
  CASE WHEN g = 'networking' THEN CAST(j->>'bytes_in' AS BIGINT) END AS src_bytes,
  CASE WHEN g = 'serverless' THEN j->>'functionName' END AS function_name,
  CASE WHEN g = 'storage' THEN j->>'size' END AS bytes,
  CASE WHEN g IN ('streaming', 'integration') THEN j->>'error_code' END AS error_code,
  CASE WHEN g = 'ml' THEN j->>'modelId' END AS model_id,
  CASE WHEN g = 'management' THEN j->>'principal' END AS user_name,
  CASE WHEN g = 'enduser' THEN j->>'userId' END AS user_key,
  CASE WHEN g = 'containers' THEN j->>'pod_name' END AS pod,
  CASE WHEN g IN ('analytics', 'datawarehouse', 'data-ai', 'compute', 'streaming', 'ml', 'management', 'devtools', 'enduser', 'media', 'containers', 'integration')
    THEN j->>'status' END AS status
  FROM p""")
def _(spark, sf):
    df = n.group_extract(parsed(spark, sf))
    part = lambda c: F.try_element_at("fields", F.lit(c)).alias(c)
    own = [part(c) for c in ("job_id", "severity", "instance", "function_name", "bytes", "model_id", "status")]
    ecs = {
        "action": "event.action", "rule_name": "rule.name", "rule_id": "rule.id", "host_id": "host.id", "src_ip": "source.ip",
        "src_port": "source.port", "src_bytes": "source.bytes", "error_code": "error.code", "user_name": "user.name",
        "user_key": "user.id", "pod": "kubernetes.pod.name",
    }
    return df.select("id", *own, *[F.col(f"`{c}`").alias(a) for a, c in ecs.items()])


@query("n14_error_extract", f"SELECT id, {J('error_code')} AS code, {J('errorMessage')} AS message, CAST(NULL AS VARCHAR) AS type FROM v_raw_logs")
def _(spark, sf):
    return show(n.error_extract(parsed(spark, sf)), code="error.code", message="error.message", type="error.type")


@query("n15_level_normalise", f"SELECT id, lower(coalesce({J('level')}, {J('logLevel')}, {J('severity')})) AS level FROM v_raw_logs")
def _(spark, sf):
    return show(n.level_normalise(parsed(spark, sf)), level="log.level")


@query("n16_vendor_promote", f"""SELECT id, CASE WHEN vendor = 'aws' THEN CASE WHEN k % 4 = 0 THEN 'mine' ELSE {J('state')} END END AS state,
  CASE WHEN vendor = 'aws' THEN {J('queryId')} END AS query_id FROM v_raw_logs""")
def _(spark, sf):
    df = n.athena_extract(parsed(spark, sf))
    df = df.withColumn("vendor_fields", F.when(F.col("k") % 4 == 0, F.create_map(F.lit("state"), F.lit("mine"))))
    out = n.vendor_promote(df, F.col("vendor") == "aws")
    own = F.when(F.col("vendor") == "aws", F.col("vendor_fields"))
    return out.select("id", F.try_element_at(own, F.lit("state")).alias("state"), F.try_element_at(own, F.lit("query_id")).alias("query_id"))


CATEGORY_SQL = """CASE svc_group WHEN 'security' THEN 'security' WHEN 'compute' THEN 'host,process' WHEN 'storage' THEN 'file'
  WHEN 'networking' THEN 'network' WHEN 'iot' THEN 'host' WHEN 'management' THEN 'configuration' WHEN 'enduser' THEN 'session'
  WHEN 'analytics' THEN 'database' WHEN 'datawarehouse' THEN 'database' WHEN 'data-ai' THEN 'database' WHEN 'databases' THEN 'database'
  ELSE 'process' END"""


@query("n17_ecs_category", f"SELECT id, coalesce(pre_kind, 'event') AS kind, {CATEGORY_SQL} AS category, 'info' AS type FROM v_raw_logs")
def _(spark, sf):
    df = n.ecs_category(raw(spark, sf))
    return df.select("id", F.col("`event.kind`").alias("kind"), F.concat_ws(",", F.col("`event.category`")).alias("category"), F.concat_ws(",", F.col("`event.type`")).alias("type"))


@query("n18_outcome_type", "SELECT id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS type FROM v_raw_logs")
def _(spark, sf):
    df = n.outcome_type(n.ecs_category(raw(spark, sf)))
    return df.select("id", F.concat_ws(",", F.col("`event.type`")).alias("type"))


@query("n19_duration_ns", f"""SELECT id, CASE WHEN k % 11 = 0 THEN 5 WHEN {IS_JSON} THEN CASE WHEN k % 4 = 0 THEN k * 1000000 + 250000
  WHEN k % 4 > 0 THEN (k % 4) * 1000000000 END END AS duration FROM v_raw_logs""")
def _(spark, sf):
    df = parsed(spark, sf).withColumn("event.duration", F.when(F.col("k") % 11 == 0, F.lit(5).cast("bigint")))
    return show(n.duration_ns(df), duration="event.duration")


GEO_SQL = """SELECT n_nationkey * 65536 * 4 + 167772160 AS ip_start, n_nationkey * 65536 * 4 + 167772160 + 65536 * 3 - 1 - n_nationkey AS ip_end,
  n_name AS country FROM nation"""


@query("n20_geo_enrich", f"""WITH g AS ({GEO_SQL}),
  l AS (SELECT id, '10.' || (user_id % 120) || '.' || (k * 2) || '.' || (k + 1) AS src, CASE WHEN k % 5 = 0 THEN 'bad' ELSE '10.' || k || '.1.2' END AS dst,
    (10 * 256 + user_id % 120) * 65536 + (k * 2) * 256 + k + 1 AS src_n, CASE WHEN k % 5 <> 0 THEN (10 * 256 + k) * 65536 + 258 END AS dst_n FROM v_raw_logs)
  SELECT l.id, l.src, l.dst, s.country AS src_country, d.country AS dst_country FROM l
  LEFT JOIN g s ON l.src_n BETWEEN s.ip_start AND s.ip_end LEFT JOIN g d ON l.dst_n BETWEEN d.ip_start AND d.ip_end""")
def _(spark, sf):
    key = F.col("n_nationkey").cast("bigint") * 65536 * 4 + 167772160
    ranges = table(spark, sf, "nation").select(key.alias("ip_start"), (key + 65536 * 3 - 1 - F.col("n_nationkey")).alias("ip_end"), F.col("n_name").alias("country"))
    src = F.concat_ws(".", F.lit("10"), F.col("user_id") % 120, F.col("k") * 2, F.col("k") + 1)
    dst = F.when(F.col("k") % 5 == 0, "bad").otherwise(F.concat_ws(".", F.lit("10"), F.col("k"), F.lit("1.2")))
    df = view(spark, sf, "raw_logs").select("id", src.alias("source.ip"), dst.alias("destination.ip"))
    out = n.geo_enrich(df, ranges)
    return show(out, src="source.ip", dst="destination.ip", src_country="source.geo.country", dst_country="destination.geo.country")


AGENTS = [("curl", "(?i)^curl/"), ("Python", "(?i)python|boto"), ("Chrome", "Chrome/[0-9]+"), ("Firefox", "Firefox/[0-9]+")]


@query("n21_user_agent", """SELECT id, CASE k % 5 WHEN 0 THEN 'curl' WHEN 1 THEN 'Python' WHEN 2 THEN 'Chrome' WHEN 3 THEN 'Other' END AS name FROM v_raw_logs""")
def _(spark, sf):
    k = F.col("k") % 5
    agent = F.when(k == 0, "CURL/8.1").when(k == 1, "aws-cli Boto3/1.2").when(k == 2, "Mozilla/5.0 Chrome/120 Safari").when(k == 3, "Mystery/1")
    return show(n.user_agent_enrich(raw(spark, sf).withColumn("user_agent.original", agent), AGENTS), name="user_agent.name")


@query("n22_related_fields", """SELECT id, CASE WHEN caller_ip = '10.2.0.7' OR pre_ip IS NULL THEN caller_ip ELSE pre_ip || ',' || caller_ip END AS ips,
  nullif(concat_ws(',', 'u' || user_id, upn), '') AS users, CASE WHEN k % 2 = 0 THEN 'h1' ELSE 'h1,h2' END AS hosts FROM v_raw_logs""")
def _(spark, sf):
    df = view(spark, sf, "raw_logs").select(
        "id", F.col("pre_ip").alias("source.ip"), F.col("caller_ip").alias("client.ip"), F.col("caller_ip").alias("destination.ip"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user.name"), F.col("upn").alias("user.email"),
        F.lit("h1").alias("host.name"), F.when(F.col("k") % 2 == 0, "h1").otherwise("h2").alias("host.hostname"),
    )
    out = n.related_fields(df)
    return out.select("id", *[F.concat_ws(",", F.col(f"`related.{c}`")).alias(a) for c, a in (("ip", "ips"), ("user", "users"), ("hosts", "hosts"))])


@query("n23_cleanup", f"""SELECT id, CAST(NULL AS VARCHAR) AS ip_left, CASE WHEN vendor = 'azure' AND upn IS NULL THEN TRUE ELSE FALSE END AS no_upn,
  CAST(NULL AS VARCHAR) AS severity_left FROM v_raw_logs""")
def _(spark, sf):
    df = n.identity_aws(n.identity_gcp(n.identity_azure(parsed(spark, sf), F.col("vendor") == "azure"), F.col("vendor") == "gcp"), F.col("vendor") == "aws")
    out = n.cleanup(df)
    return out.select(
        "id", F.coalesce("callerIpAddress", "`aws.cloudtrail.sourceIPAddress`").alias("ip_left"),
        ((F.col("vendor") == "azure") & F.col("`user.email`").isNull()).alias("no_upn"), F.col("severity").alias("severity_left"),
    )


@query("n24_tag_on_error", f"""SELECT id, CASE WHEN {J('errorMessage')} IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN 'preserve_original_event,x' ELSE 'x,preserve_original_event' END
  ELSE CASE WHEN k % 2 = 0 THEN 'preserve_original_event,x' ELSE 'x' END END AS tags FROM v_raw_logs""")
def _(spark, sf):
    tags = F.when(F.col("k") % 2 == 0, F.array(F.lit("preserve_original_event"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    out = n.tag_on_error(n.error_extract(parsed(spark, sf).withColumn("tags", tags)))
    return out.select("id", F.concat_ws(",", "tags").alias("tags"))


SERVICES = "('aws.lambda_logs'), ('aws.glue'), ('aws.fargate'), ('aws.wafv2'), ('aws.s3access'), ('aws.vpcflow')"
ROUTED = f"""WITH d(dataset) AS (VALUES {SERVICES}), s AS (SELECT substr(dataset, 5) AS suffix, dataset FROM d),
  r AS (SELECT suffix AS slug, dataset FROM s UNION SELECT regexp_replace(suffix, '_logs$', ''), dataset FROM s),
  l AS (SELECT id, CASE k % 7 WHEN 0 THEN '/aws/lambda/fn' WHEN 1 THEN '/ecs/app' WHEN 2 THEN 'aws-cloudtrail-logs-1' WHEN 3 THEN 'aws-waf-logs-x'
      WHEN 4 THEN '/aws/unknown/y' WHEN 5 THEN '' ELSE NULL END AS log_group,
    CASE k % 4 WHEN 0 THEN 'p/AWSLogs/123/VPCFlow/x.gz' WHEN 1 THEN 'AWSLogs/12/lambda_logs/y' WHEN 2 THEN 'AWSLogs/ab/glue/z' ELSE NULL END AS s3_key FROM v_raw_logs)"""


def ingest(spark, sf):
    g, s = F.col("k") % 7, F.col("k") % 4
    group = F.when(g == 0, "/aws/lambda/fn").when(g == 1, "/ecs/app").when(g == 2, "aws-cloudtrail-logs-1").when(g == 3, "aws-waf-logs-x").when(
        g == 4, "/aws/unknown/y").when(g == 5, "")
    key = F.when(s == 0, "p/AWSLogs/123/VPCFlow/x.gz").when(s == 1, "AWSLogs/12/lambda_logs/y").when(s == 2, "AWSLogs/ab/glue/z")
    return view(spark, sf, "raw_logs").select("id", group.alias("log_group"), key.alias("s3_key"))


def routes(spark):
    names = ["aws.lambda_logs", "aws.glue", "aws.fargate", "aws.wafv2", "aws.s3access", "aws.vpcflow"]
    return n.service_route_map(spark.createDataFrame([(x,) for x in names], "dataset string"))


@query("n25_reroute_by_log_group", ROUTED + """ SELECT l.id, CASE WHEN log_group LIKE '/ecs/%' THEN 'aws.fargate' WHEN log_group LIKE 'aws-waf-logs-%' THEN 'aws.wafv2'
  ELSE r.dataset END AS target_dataset FROM l LEFT JOIN r ON r.slug = nullif(regexp_extract(log_group, '^/aws/([^/]+)', 1), '')""")
def _(spark, sf):
    return n.reroute_by_log_group(ingest(spark, sf), routes(spark)).select("id", "target_dataset")


@query("n26_reroute_by_s3_key", ROUTED + """ SELECT l.id, r.dataset AS target_dataset FROM l
  LEFT JOIN r ON r.slug = lower(regexp_extract(s3_key, 'AWSLogs/[0-9]+/([^/]+)/', 1))""")
def _(spark, sf):
    return n.reroute_by_s3_key(ingest(spark, sf), routes(spark)).select("id", "target_dataset")


@query("n27_reroute_firehose", ROUTED + """ SELECT l.id, coalesce(a.dataset, b.dataset) AS target_dataset FROM l
  LEFT JOIN r a ON a.slug = nullif(regexp_extract(log_group, '^/aws/([^/]+)', 1), '')
  LEFT JOIN r b ON b.slug = lower(regexp_extract(s3_key, 'AWSLogs/[0-9]+/([^/]+)/', 1))""")
def _(spark, sf):
    return n.reroute_firehose(ingest(spark, sf), routes(spark)).select("id", "target_dataset")


@query("n28_service_route_map", """WITH d AS (SELECT DISTINCT 'aws.' || event_type || CASE WHEN user_id % 2 = 0 THEN '_logs' ELSE '' END AS dataset FROM events),
  s AS (SELECT substr(dataset, 5) AS suffix, dataset FROM d), r AS (SELECT suffix AS slug, dataset FROM s UNION SELECT regexp_replace(suffix, '_logs$', ''), dataset FROM s)
  SELECT slug, max(dataset) AS dataset FROM r GROUP BY slug""")
def _(spark, sf):
    ev = table(spark, sf, "events")
    names = ev.select(F.concat(F.lit("aws."), "event_type", F.when(F.col("user_id") % 2 == 0, "_logs").otherwise("")).alias("dataset")).distinct()
    return n.service_route_map(names)


SOURCE_SQL = "CASE k % 5 WHEN 0 THEN 's3' WHEN 1 THEN 'firehose' WHEN 2 THEN 'otel' WHEN 3 THEN 'cloudwatch' ELSE 'odd' END"


def _source():
    s = F.col("k") % 5
    return F.when(s == 0, "s3").when(s == 1, "firehose").when(s == 2, "otel").when(s == 3, "cloudwatch").otherwise("odd")


@query("n29_resolve_dataset", f"""SELECT id, CASE k % 3 WHEN 0 THEN 'aws.elb_logs' WHEN 1 THEN 'aws.vpcflow' ELSE
  CASE {SOURCE_SQL} WHEN 's3' THEN 'aws_logs.generic' WHEN 'firehose' THEN 'awsfirehose' ELSE 'aws.cloudwatch_logs' END END AS dataset FROM v_raw_logs""")
def _(spark, sf):
    service = F.when(F.col("k") % 3 == 0, "alb").when(F.col("k") % 3 == 1, "vpc").otherwise("glue")
    return view(spark, sf, "raw_logs").select("id", n.resolve_dataset(service, _source()).alias("dataset"))


@query("n30_normalise_dataset", f"""WITH g AS (SELECT *, CASE {SOURCE_SQL} WHEN 's3' THEN 'aws_logs.generic' WHEN 'firehose' THEN 'awsfirehose' ELSE 'aws.cloudwatch_logs' END AS generic
    FROM v_raw_logs)
  SELECT id, CASE k % 6 WHEN 0 THEN 'aws.ec2_logs' WHEN 1 THEN 'aws.inspector' WHEN 2 THEN 'aws.waf' WHEN 3 THEN generic
    ELSE CASE WHEN k % 2 = 0 AND generic <> 'aws.cloudwatch_logs' THEN generic ELSE 'aws.glue' END END AS dataset FROM g""")
def _(spark, sf):
    given = F.col("k") % 6
    ds = F.when(given == 0, "aws.ec2").when(given == 1, "aws.inspector2").when(given == 2, "aws.waf").when(given == 3, F.lit(None)).otherwise("aws.glue")
    return view(spark, sf, "raw_logs").select("id", n.normalise_dataset(ds, _source(), F.col("k") % 2 == 0).alias("dataset"))


@query("n31_skip_foreign", """SELECT id, CASE WHEN k % 3 = 1 THEN NULL ELSE 'aws' END AS module FROM v_raw_logs""")
def _(spark, sf):
    tag = F.when(F.col("k") % 3 == 0, "aws.glue").when(F.col("k") % 3 == 1, "servicenow.event")
    df = view(spark, sf, "raw_logs").select("id", "k", tag.alias("__dataset"), F.lit("aws.glue").alias("dataset"))
    return show(n.skip_foreign(df, "aws", n.enrich_defaults), module="event.module")


@query("n32_enrich_defaults", """SELECT id, 'logs' AS stream, dataset, CASE WHEN k % 2 = 0 THEN 'team-a' ELSE 'default' END AS namespace, 'aws' AS module,
  coalesce(CASE WHEN k % 3 = 0 THEN 'named' END, 'svc-' || event_type) AS service, '8.11.0' AS version FROM v_raw_logs""")
def _(spark, sf):
    df = view(spark, sf, "raw_logs").select(
        "id", "dataset", F.when(F.col("k") % 2 == 0, "team-a").alias("data_stream.namespace"), F.when(F.col("k") % 3 == 0, "named").alias("service.name"),
        F.concat(F.lit("svc-"), "event_type").alias("service_id"),
    )
    return show(
        n.enrich_defaults(df), stream="data_stream.type", dataset="event.dataset", namespace="data_stream.namespace", module="event.module",
        service="service.name", version="ecs.version",
    )


@query("n33_level_from_outcome", f"""SELECT id, coalesce({HAS_LEVEL}, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END) AS level FROM v_raw_logs""")
def _(spark, sf):
    df = view(spark, sf, "raw_logs").select("id", F.col("envelope_level").alias("log.level"), F.col("outcome").alias("event.outcome"))
    return show(n.level_from_outcome(df), level="log.level")


@query("n34_gcp_azure_enrich", """SELECT id, coalesce(CASE WHEN k % 4 = 0 THEN 'gcp.own' END, CASE event_type WHEN 'view' THEN 'gcp.loadbalancing_logs' ELSE 'gcp.' || event_type END) AS dataset,
  'gcp' AS module, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, concat_ws(',', pre_ip, caller_ip) AS ips FROM v_raw_logs""")
def _(spark, sf):
    df = view(spark, sf, "raw_logs").select(
        "id", F.col("event_type").alias("service_id"), F.when(F.col("k") % 4 == 0, "gcp.own").alias("event.dataset"), F.col("outcome").alias("event.outcome"),
        F.col("pre_ip").alias("source.ip"), F.col("caller_ip").alias("server.ip"),
    )
    out = n.gcp_azure_enrich(df, "gcp", {"view": "gcp.loadbalancing_logs"})
    return out.select("id", F.col("`event.dataset`").alias("dataset"), F.col("`event.module`").alias("module"), F.col("`log.level`").alias("level"), F.concat_ws(",", F.col("`related.ip`")).alias("ips"))


@query("n35_drop_nulls", """SELECT '{"id":' || id || CASE WHEN outcome IS NULL THEN ',"event":{' ELSE ',"event":{"outcome":"' || outcome || '"' END
  || CASE WHEN pre_kind IS NULL THEN '}' WHEN outcome IS NULL THEN '"kind":"state"}' ELSE ',"kind":"state"}' END
  || CASE WHEN upn IS NULL THEN '}' ELSE ',"upn":"' || upn || '"}' END AS document FROM v_raw_logs""")
def _(spark, sf):
    df = view(spark, sf, "raw_logs").select("id", F.col("outcome").alias("event.outcome"), F.col("pre_kind").alias("event.kind"), "upn")
    return n.to_document(df)


@query("n36_explode_native_metrics", """SELECT id, 'gcp' AS source, date_trunc('second', ts) + to_minutes(i) AS at, 'custom/' || event_type AS metric, CAST(k + i AS DOUBLE) AS value, 'gce' AS resource
  FROM v_raw_logs, (SELECT unnest([0, 1]) AS i) WHERE vendor = 'gcp'
  UNION ALL SELECT id, 'azure', date_trunc('second', ts), event_type, CAST(k AS DOUBLE) / 2, 'rg-' || (k % 3) FROM v_raw_logs WHERE vendor = 'azure'""")
def _(spark, sf):
    at = lambda m: F.date_format(F.date_trunc("second", "ts") + F.expr(f"INTERVAL {m} MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    df = view(spark, sf, "raw_logs")
    point = lambda i: F.format_string('{"interval":{"endTime":"%s"},"value":{"doubleValue":%d}}', at(i), F.col("k") + i)
    series = F.format_string('{"metric":{"type":"custom/%s","labels":{}},"resource":{"type":"gce","labels":{}},"points":[%s,%s]}', F.col("event_type"), point(0), point(1))
    azure = F.format_string('{"time":"%s","metricName":"%s","resourceGroup":"rg-%d","timeseries":[{"data":[{"average":%s,"count":1}]}]}',
                            at(0), F.col("event_type"), F.col("k") % 3, (F.col("k") / 2.0).cast("string"))
    return n.explode_native_metrics(df.select("id", F.when(F.col("vendor") == "gcp", series).alias("monitoringTimeSeries"), F.when(F.col("vendor") == "azure", azure).alias("azureMonitorMetric")))


@query("n37_metric_rollup", f"""SELECT {tb('60 seconds')} AS period_start, dataset, metric, sum(amount) / CAST(count(*) AS DOUBLE) AS avg, CAST(sum(amount) AS BIGINT) AS sum,
  count(*) AS "count", min(amount) AS min, max(amount) AS max FROM v_metric_points GROUP BY 1, 2, 3""")
def _(spark, sf):
    return n.metric_rollup(view(spark, sf, "metric_points"), ["dataset", "metric"], "amount")


def itsm(spark, sf):
    """Asset rows as tagged records of value / display pairs."""
    pair = lambda v, d: F.struct(v.cast("string").alias("value"), d.cast("string").alias("display_value"))
    rec = F.create_map(
        F.lit("name"), pair(F.col("name"), F.col("name")), F.lit("category"), pair(F.col("category"), F.col("category")),
        F.lit("owned_by"), pair(F.col("ci_id"), F.col("owner")), F.lit("department"), pair(F.col("nation"), F.col("department")),
    )
    tag = F.when(F.col("category") == "Furniture", "cmdb_ci_service").otherwise("cmdb_ci")
    return view(spark, sf, "ci").select("ts", F.array(tag, F.lit("servicenow-event")).alias("tags"), rec.alias("rec"))


@query("n38_itsm_flatten", """SELECT ts, name, category, CAST(NULL AS VARCHAR) AS fqdn, owner AS owned_by_name, department AS department_name FROM v_ci WHERE category <> 'Furniture'""")
def _(spark, sf):
    return n.itsm_flatten(itsm(spark, sf), "cmdb_ci", ["name", "category", "fqdn"], ["owned_by", "department"])


@query("n39_outcome_from_vendor", """SELECT id, CASE WHEN vendor = 'gcp' THEN CASE WHEN k % 3 = 0 THEN 'success' WHEN k % 3 = 1 THEN 'failure' END
  WHEN vendor = 'azure' THEN CASE k % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'success' WHEN 2 THEN 'failure' END END AS outcome FROM v_raw_logs""")
def _(spark, sf):
    code = F.when(F.col("k") % 3 == 0, 0).when(F.col("k") % 3 == 1, 7)
    result = F.when(F.col("k") % 4 == 0, "Success").when(F.col("k") % 4 == 1, "Succeeded").when(F.col("k") % 4 == 2, "Failed")
    df = view(spark, sf, "raw_logs").select("id", "vendor", code.alias("status_code"), result.alias("resultType"))
    return show(n.outcome_from_vendor(df), outcome="event.outcome")


@query("n40_vendor_resource_map", """SELECT id, '/sub/' || user_id AS instance, CAST(k AS VARCHAR) AS status, 'gcloud/1' AS agent,
  CASE WHEN upn IS NOT NULL THEN 'app' END AS agent_name, 'gce' AS service, 'p' || (k % 3) AS project FROM v_raw_logs""")
def _(spark, sf):
    df = view(spark, sf, "raw_logs").select(
        "id", F.concat(F.lit("/sub/"), "user_id").alias("resourceId"), F.format_string('{"statusCode":%d}', "k").alias("properties"),
        F.col("proto").alias("protoPayload"), F.when(F.col("upn").isNotNull(), F.create_map(F.lit("appid"), F.lit("app"))).alias("identity.claims"),
        F.format_string('{"type":"gce","labels":{"project_id":"p%d"}}', F.col("k") % 3).alias("resource"),
    )
    return show(
        n.vendor_resource_map(df), instance="cloud.instance.id", status="http.response.status_code", agent="user_agent.original",
        agent_name="user_agent.name", service="cloud.service.name", project="cloud.project.id",
    )


@query("n41_otel_labels", """SELECT id, CASE k % 4 WHEN 0 THEN 'gcp.cloud_trace.trace_id=t' || id || ',gcp.google_cloud_otel.propagator=cloud_trace_context,gcp.otel.csp_distro=otelopscol,team=a'
  WHEN 1 THEN 'team=a' WHEN 2 THEN 'gcp.cloud_trace.trace_id=old,team=a' ELSE '' END AS labels FROM v_raw_logs""")
def _(spark, sf):
    m = F.col("k") % 4
    old = F.create_map(F.lit("gcp.cloud_trace.trace_id"), F.lit("old"), F.lit("team"), F.lit("a"))
    labels = F.when(m == 0, F.create_map(F.lit("team"), F.lit("a"))).when(m < 3, old).otherwise(F.create_map(F.lit("gcp.otel.csp_distro"), F.lit("x")))
    mode = F.when(m == 0, fx.GATEWAY_SOURCE).when(m == 2, "cloudwatch").otherwise("otel")
    df = view(spark, sf, "raw_logs").select("id", labels.alias("labels"), mode.alias("ingestion_source"), F.concat(F.lit("t"), "id").alias("trace.id"))
    out = n.otel_correlation_labels(df, "gcp")
    text = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e.key, F.lit("="), e.value))), ",")
    return out.select("id", F.coalesce(text, F.lit("")).alias("labels"))


@query("n00_normalised_logs", f"""WITH p AS (SELECT *, CASE WHEN json_valid(message) THEN message::JSON END AS j FROM v_raw_logs)
  SELECT id, '9.3.0' AS version, coalesce(pre_kind, 'event') AS kind, {CATEGORY_SQL} AS category,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS type,
  coalesce(pre_ip, CASE WHEN vendor = 'gcp' THEN CASE WHEN {IS_JSON} AND k % 2 = 0 THEN '10.1.0.1' ELSE '10.1.0.2' END ELSE caller_ip END) AS src_ip,
  CASE WHEN vendor = 'gcp' THEN CASE WHEN {IS_JSON} AND k % 2 = 0 THEN 'm.inner' ELSE 'm.outer' END ELSE operation_name END AS action,
  lower(coalesce(CASE WHEN svc_group IN ('analytics', 'compute', 'ml', 'serverless') THEN CASE k % 9 WHEN 0 THEN 'ERROR' WHEN 4 THEN 'WARN' END END,
    CASE WHEN vendor <> 'aws' THEN {HAS_LEVEL} END, j->>'level', j->>'logLevel', CASE WHEN svc_group IS DISTINCT FROM 'security' THEN j->>'severity' END)) AS level,
  CASE WHEN k % 9 = 1 THEN (k + 1) * 1000000 WHEN k % 9 = 2 THEN (k % 4) * 1000000000
    WHEN {IS_JSON} THEN CASE WHEN k % 4 = 0 THEN k * 1000000 + 250000 ELSE (k % 4) * 1000000000 END END AS duration,
  CASE WHEN j IS NOT NULL THEN 'preserve_original_event' ELSE '' END AS tags, message AS original
  FROM p""")
def _(spark, sf):
    out = n.normalise(raw(spark, sf))
    return out.select(
        "id", F.col("ecs.version"), F.col("event.kind"), F.concat_ws(",", "event.category").alias("category"), F.concat_ws(",", "event.type").alias("type"),
        F.col("source.ip").alias("src_ip"), F.col("event.action"), F.col("log.level"), F.col("event.duration"), F.concat_ws(",", "tags").alias("tags"),
        F.col("event.original"),
    )
