"""Registered sources and sinks: each writes whole provided tables to a fresh shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions.timebucket import lookback
from skyledger.operators.correlation import attack_source
from skyledger.plans.adapters import table, view
from skyledger.plans.dashboard_queries import logs
from skyledger.plans.registry import query
from skyledger.session import scratch_path
from skyledger.sources import sinks
from skyledger.sources.routing import o365_metrics_target, route_target
from skyledger.sources.streams import read_raw_json, read_stream, read_streams


def stored(spark, sf):
    """Log rows and metric points written to stream tables."""
    root = scratch_path(spark, "streams")
    rows = logs(spark, sf).select("id", "ts", "host", "outcome", F.concat(F.lit("logs-"), "dataset", F.lit("-default")).alias("target"))
    points = view(spark, sf, "metric_points").select("id", "ts", "metric", "amount", F.concat(F.lit("metrics-"), "dataset", F.lit("-default")).alias("target"))
    sinks.write_by_stream(rows, root)
    sinks.write_by_stream(points, root)
    return root


@query("s01_read_stream", "SELECT id, dataset, host FROM v_logs WHERE dataset LIKE 'aws.%'")
def _(spark, sf):
    return read_stream(spark, stored(spark, sf), "logs-aws.*").select("id", "dataset", "host")


@query("s02_read_streams", """SELECT id, dataset, host, CAST(NULL AS VARCHAR) AS metric FROM v_logs WHERE dataset LIKE 'aws.%' OR dataset = 'gcp.audit'
  UNION ALL SELECT id, dataset, NULL, metric FROM v_metric_points WHERE dataset LIKE 'azure.%'""")
def _(spark, sf):
    df = read_streams(spark, stored(spark, sf), "logs-aws.*", "logs-gcp.audit-*", "metrics-azure.*-default")
    return df.select("id", "dataset", "host", "metric")


@query("s03_lookback", "SELECT id, ts FROM v_logs WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts <= TIMESTAMP '2024-01-20 06:00:00'")
def _(spark, sf):
    df = read_stream(spark, stored(spark, sf), "logs-*")
    return lookback(df, "2024-01-20 06:00:00", "10 DAYS", date_col="date").select("id", "ts")


@query("s04_read_raw_json", "SELECT message AS raw, k % 9 NOT IN (0, 1, 3, 4, 5) AS parsed, CASE WHEN k % 9 NOT IN (0, 1, 3, 4, 5) THEN json_extract_string(message, '$.job_id') END AS job_id FROM v_raw_logs")
def _(spark, sf):
    path = scratch_path(spark, "ndjson")
    view(spark, sf, "raw_logs").select("message").write.text(path)
    return read_raw_json(spark, path).select("raw", F.col("doc").isNotNull().alias("parsed"), F.try_element_at("doc", F.lit("job_id")).alias("job_id"))


ROUTE_SQL = """SELECT id, CASE WHEN t = 'apm' THEN 'traces-apm-default' WHEN t = 'metrics-aws.emr' THEN 'metrics-aws.emr-default' WHEN t = 'servicenow.event' THEN 'logs-servicenow.event-default'
  WHEN t = 'aws.xray' THEN CASE WHEN vendor = 'aws' THEN 'traces-aws.xray-default' ELSE 'logs-aws.xray-default' END
  WHEN vendor = 'aws' AND d LIKE 'aws.%' THEN 'logs-aws.' || substr(d, 5) || '-default' WHEN vendor = 'aws' AND d LIKE 'gcp.%' THEN 'logs-aws.' || d || '-default'
  WHEN d LIKE '%.%' AND d NOT LIKE 'custom%' THEN 'logs-' || vendor || '.' || split_part(d, '.', 2) || '-default' ELSE 'logs-' || d || '-default' END AS target,
  'metrics-o365_metrics.' || event_type || '-default' AS o365
  FROM (SELECT id, event_type, CASE user_id % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END AS vendor,
    CASE k % 8 WHEN 0 THEN 'apm' WHEN 1 THEN 'metrics-aws.emr' WHEN 2 THEN 'servicenow.event' WHEN 3 THEN 'aws.xray' END AS t,
    CASE WHEN k % 8 = 4 THEN 'custom.app' WHEN user_id % 3 = 0 AND k % 8 = 5 THEN 'gcp.audit' ELSE CASE user_id % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END || '.svc' END AS d FROM v_logs)"""


def routed(spark, sf):
    k = F.col("k") % 8
    tag = F.when(k == 0, "apm").when(k == 1, "metrics-aws.emr").when(k == 2, "servicenow.event").when(k == 3, "aws.xray")
    run = F.when(k == 4, "custom.app").when((F.col("user_id") % 3 == 0) & (k == 5), "gcp.audit").otherwise(F.concat("vendor", F.lit(".svc")))
    target = route_target(F.col("vendor"), F.concat(F.lit("logs-"), F.col("vendor")), run, tag)
    return logs(spark, sf).withColumn("target", target)


@query("s05_route_target", ROUTE_SQL)
def _(spark, sf):
    o365 = o365_metrics_target(F.when(F.col("k") % 2 == 0, F.concat(F.lit("o365_metrics."), "event_type")).otherwise(F.col("event_type")))
    return routed(spark, sf).select("id", "target", o365.alias("o365"))


@query("s06_write_by_stream", f"""SELECT split_part(target, '-', 1) AS signal, regexp_extract(target, '^[^-]+-(.+)-[^-]+$', 1) AS dataset, count(*) AS "rows" FROM ({ROUTE_SQL}) GROUP BY 1, 2""")
def _(spark, sf):
    root = scratch_path(spark, "bystream")
    sinks.write_by_stream(routed(spark, sf).select("id", "ts", "target"), root)
    return spark.read.parquet(root).groupBy("signal", "dataset").agg(F.count("*").alias("rows"))


@query("s07_append_new", """WITH n AS (SELECT count(*) AS offered, count(DISTINCT CASE WHEN o_orderkey IS NULL THEN l_orderkey END) AS created FROM lineitem
  LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey)
  SELECT created, offered - created AS skipped FROM n""")
def _(spark, sf):
    """Line items offered by order key against finished orders already stored."""
    path = scratch_path(spark, "appendnew")
    table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")).write.parquet(path)
    offered = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    done = sinks.append_new(offered, path, "id", spark.read.parquet(path))
    stored_rows = spark.read.parquet(path).agg(F.count("*").alias("n"))
    return stored_rows.select(F.lit(done["created"]).cast("bigint").alias("created"), F.lit(done["skipped"]).cast("bigint").alias("skipped"))


@query("s07_filtered_append", """WITH c AS (SELECT count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders),
  l AS (SELECT count(*) AS items FROM lineitem)
  SELECT step, created, skipped, groups_read FROM c, l, (VALUES
    (1, c.finished, 0, 0), (2, c.open, 0, 0), (3, c.orders - c.finished - c.open, c.finished, 1), (4, 0, l.items, 3)) v(step, created, skipped, groups_read)""")
def _(spark, sf):
    """Finished orders, open orders, then all orders that are not open, then every line item's order: only groups that may hold a key are read."""
    path = scratch_path(spark, "filtered")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("?").alias("o_orderstatus"))
    offers = [orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus <> 'O'"), items]
    done = [sinks.append_filtered(offer, path, "id") for offer in offers]
    return spark.createDataFrame([(i + 1, d["created"], d["skipped"], d["groups_read"]) for i, d in enumerate(done)], "step int, created bigint, skipped bigint, groups_read int")


@query("s08_size_capped_write", """SELECT count(*) AS lines, TRUE AS within_cap, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS lost,
  CAST(sum(CASE WHEN strlen(text) > 1048576 THEN 1 ELSE 0 END) AS BIGINT) AS oversized FROM documents""")
def _(spark, sf):
    path = scratch_path(spark, "capped")
    docs = table(spark, sf, "documents")
    written = sinks.size_capped_write(docs, path, "doc_id", max_bytes=1024 * 1024)
    back = spark.read.text(path).select(F.col("_metadata.file_path").alias("unit"), "value", F.from_json("value", "doc_id long, text string").alias("d"))
    units = back.groupBy("unit").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("size"), F.sum("d.doc_id").alias("ids"), F.sum(F.length("d.text")).alias("chars"))
    lost = docs.join(back.select("d.doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("lost"))
    sums = units.agg(F.sum("n").alias("lines"), (F.max("size") <= 1024 * 1024).alias("within_cap"), F.sum("ids").alias("ids"), F.sum("chars").cast("bigint").alias("chars"))
    return sums.join(lost).select("*", F.lit(written["oversized"]).cast("bigint").alias("oversized"))


@query("s09_dead_letter", """SELECT id, CASE WHEN k % 9 = 3 THEN 'pipeline_error' END AS kind, CASE WHEN k % 9 = 3 THEN 'broken JSON' END AS error,
  CASE WHEN k % 9 = 3 THEN 'preserve_original_event' ELSE '' END AS tags FROM v_raw_logs""")
def _(spark, sf):
    raw = view(spark, sf, "raw_logs")
    broken = F.col("message").startswith("{") & F.from_json("message", "map<string,string>").isNull()
    good, bad = sinks.dead_letter(raw.select("id", F.when(broken, "broken JSON").alias("failure")))
    both = good.unionByName(bad, allowMissingColumns=True)
    return both.select("id", F.col("`event.kind`").alias("kind"), F.col("`error.message`").alias("error"), F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"))


@query("s10_metric_series", "SELECT metric, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date, count(*) AS points, count(DISTINCT host) AS series, CAST(sum(amount) AS BIGINT) AS total FROM v_metric_points GROUP BY 1, 2")
def _(spark, sf):
    path = scratch_path(spark, "series")
    points = view(spark, sf, "metric_points").withColumn("dims", F.create_map(F.lit("host"), F.col("host")))
    sinks.write_metric_series(points.select("ts", "metric", "dims", "amount"), path)
    back = spark.read.parquet(path)
    return back.groupBy("metric", "date").agg(F.count("*").alias("points"), F.count_distinct("dims_hash").alias("series"), F.sum("amount").alias("total"))


@query("s11_write_otlp", """SELECT count(*) AS spans, count(DISTINCT trace_id) AS traces, count(DISTINCT service) AS services, CAST(sum(length(name)) AS BIGINT) AS name_chars,
  count(CASE WHEN outcome = 'failure' THEN 1 END) AS failed FROM v_spans""")
def _(spark, sf):
    path = scratch_path(spark, "otlp")
    sinks.write_otlp(view(spark, sf, "spans"), path)
    span = "struct<traceId:string,spanId:string,name:string,status:struct<code:int>>"
    resource = "struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>>"
    schema = f"struct<resourceSpans:array<struct<resource:{resource},scopeSpans:array<struct<spans:array<{span}>>>>>>"
    lines = spark.read.text(path).select(F.explode(F.from_json("value", schema)["resourceSpans"]).alias("r"))
    service = F.get(F.filter("r.resource.attributes", lambda x: x["key"] == "service.name"), 0)["value"]["stringValue"]
    spans = lines.select(service.alias("service"), F.explode(F.flatten(F.transform("r.scopeSpans", lambda y: y.spans))).alias("s"))
    return spans.agg(
        F.count("*").alias("spans"), F.count_distinct("s.traceId").alias("traces"), F.count_distinct("service").alias("services"),
        F.sum(F.length("s.name")).alias("name_chars"), F.count_if(F.col("s.status.code") == 2).alias("failed"),
    )


@query("s12_write_enriched_alerts", "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date, 'enrichment' AS kind, 'security.alert.enriched' AS stream_dataset, count(*) AS alerts FROM v_alerts GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "enriched")
    sinks.write_enriched_alerts(attack_source(view(spark, sf, "alerts"), logs(spark, sf)), path)
    return spark.read.parquet(path).groupBy("date", "kind", "stream_dataset").agg(F.count("*").alias("alerts"))
