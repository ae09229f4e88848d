"""Registered objectives, posture, knowledge-base and data-quality queries over the whole provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import knowledge as kb
from skyledger.operators import posture as p
from skyledger.operators import quality as q
from skyledger.operators import slo as s
from skyledger.plans.adapters import table, view
from skyledger.plans.dashboard_queries import logs, rnd
from skyledger.plans.registry import query


def good():
    return F.col("outcome") == "success"


@query("l01_sli", """SELECT dataset, count(*) FILTER (WHERE outcome = 'success') AS good, count(*) AS total,
  count(*) FILTER (WHERE outcome = 'success') / CAST(count(*) AS DOUBLE) AS sli FROM v_logs GROUP BY 1""")
def _(spark, sf):
    return s.sli(logs(spark, sf), good(), keys=["dataset"])


def rolling_sql(key: str, target: float, total: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    cols = f"{key}, " if key else ""
    return f"""WITH d AS (SELECT {cols}CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, count(*) FILTER (WHERE outcome = 'success' AND {total}) AS g, count(*) FILTER (WHERE {total}) AS t
    FROM v_logs GROUP BY ALL),
  r AS (SELECT {cols}day, CAST(sum(g) OVER w AS BIGINT) AS good, CAST(sum(t) OVER w AS BIGINT) AS total FROM d
    WINDOW w AS ({part} ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)),
  i AS (SELECT *, good / CAST(nullif(total, 0) AS DOUBLE) AS sli FROM r)
  SELECT *, round((1 - sli) / (1 - {target}::DOUBLE), 6) AS burn, round(1 - (1 - sli) / (1 - {target}::DOUBLE), 6) AS budget_left, sli >= {target} AS met FROM i"""


@query("l02_slo_rolling", rolling_sql("dataset", 0.995, "TRUE"))
def _(spark, sf):
    return s.slo_rolling(logs(spark, sf), good(), s.AVAILABILITY_TARGET, keys=["dataset"])


@query("l03_database_slo", rolling_sql("", 0.99, "category = 'database'"))
def _(spark, sf):
    return s.database_slo(logs(spark, sf))


@query("l04_error_budget", """WITH c AS (SELECT region, count(*) FILTER (WHERE outcome = 'success') AS good, count(*) AS total FROM v_logs GROUP BY 1),
  i AS (SELECT *, good / CAST(total AS DOUBLE) AS sli FROM c)
  SELECT *, round((1 - sli) / (1 - 0.995::DOUBLE), 6) AS burn, round(1 - (1 - sli) / (1 - 0.995::DOUBLE), 6) AS budget_left, sli >= 0.995 AS met FROM i""")
def _(spark, sf):
    return s.error_budget(s.sli(logs(spark, sf), good(), keys=["region"]), s.AVAILABILITY_TARGET)


# ---- posture --------------------------------------------------------------------------------------------------

TIE = ["id", "evaluation"]
LATEST = """l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, resource_id ORDER BY ts DESC, id DESC, evaluation DESC) AS rn FROM v_posture) WHERE rn = 1)"""


def latest(spark, sf):
    return p.posture_latest(view(spark, sf, "posture"), ["evaluation", "benchmark", "section", "posture_type", "account"], TIE)


@query("p01_posture_latest", f"WITH {LATEST} SELECT rule_id, resource_id, ts, evaluation FROM l")
def _(spark, sf):
    return latest(spark, sf).select("rule_id", "resource_id", "ts", "evaluation")


@query("p02_posture_score", f"""WITH {LATEST} SELECT posture_type, benchmark, section, CAST(grouping_id(posture_type, benchmark, section) AS BIGINT) AS level,
  count(*) FILTER (WHERE evaluation = 'passed') AS passed, count(*) FILTER (WHERE evaluation = 'failed') AS failed,
  {rnd("count(*) FILTER (WHERE evaluation = 'passed') * 100.0 / count(*)")} AS pass_rate FROM l GROUP BY ROLLUP (posture_type, benchmark, section)""")
def _(spark, sf):
    return p.posture_score(latest(spark, sf), ["posture_type", "benchmark", "section"])


@query("p02_posture_score_by_account", f"""WITH {LATEST} SELECT account, benchmark, CAST(grouping_id(account, benchmark) AS BIGINT) AS level,
  count(*) FILTER (WHERE evaluation = 'passed') AS passed, count(*) FILTER (WHERE evaluation = 'failed') AS failed,
  {rnd("count(*) FILTER (WHERE evaluation = 'passed') * 100.0 / count(*)")} AS pass_rate FROM l GROUP BY ROLLUP (account, benchmark)""")
def _(spark, sf):
    return p.posture_score(latest(spark, sf), ["account", "benchmark"])


@query("p03_posture_rule_join", "SELECT f.id, f.rule_id, r.name, r.profile FROM v_posture f LEFT JOIN v_rules r ON r.rule_id = f.rule_id")
def _(spark, sf):
    return p.posture_rule_join(view(spark, sf, "posture").select("id", "rule_id"), view(spark, sf, "rules"))


@query("p03_rules_never_evaluated", "SELECT rule_id, name FROM v_rules WHERE rule_id NOT IN (SELECT rule_id FROM v_posture)")
def _(spark, sf):
    return p.rules_never_evaluated(view(spark, sf, "rules"), view(spark, sf, "posture")).select("rule_id", "name")


@query("p04_posture_drift", """WITH d AS (SELECT rule_id, resource_id, ts, evaluation, lag(evaluation) OVER w AS pe, lag(ts) OVER w AS pt FROM v_posture
    WINDOW w AS (PARTITION BY rule_id, resource_id ORDER BY ts, id, evaluation))
  SELECT rule_id, resource_id, pt AS passed_at, ts AS failed_at FROM d WHERE pe = 'passed' AND evaluation = 'failed'""")
def _(spark, sf):
    return p.posture_drift(view(spark, sf, "posture"), TIE)


@query("p05_finding_map", """SELECT id, CASE evaluation WHEN 'failed' THEN 'failure' ELSE 'success' END AS outcome, CASE evaluation WHEN 'failed' THEN 'warn' ELSE 'info' END AS level,
  'elastic_' || posture_type AS provider FROM v_posture""")
def _(spark, sf):
    return p.finding_map(view(spark, sf, "posture")).select("id", "outcome", "level", "provider")


# ---- knowledge base -------------------------------------------------------------------------------------------

CHUNKS = r"""s AS (SELECT doc_id, lang AS category, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS content FROM documents),
  c AS (SELECT * FROM s WHERE length(content) > 50)"""


def chunks(spark, sf):
    return kb.chunk_markdown(view(spark, sf, "markdown"))


@query("k01_chunk_markdown", f"""WITH {CHUNKS}, w AS (SELECT doc_id, category, content FROM v_markdown WHERE doc_id NOT IN (SELECT doc_id FROM c) AND length(content) > 50)
  SELECT doc_id, category, 'Step' AS title, 'Guide ' || doc_id AS parent_title, content FROM c
  UNION ALL SELECT doc_id, category, 'Guide ' || doc_id, NULL, content FROM w""")
def _(spark, sf):
    return chunks(spark, sf).select("doc_id", "category", "title", "parent_title", "content")


def flagged(spark, sf):
    """Whole documents as chunks, with words that the tags look for derived from each row."""
    k = F.col("doc_id") % 10
    extra = F.when(k == 0, " Containment TA0001 T1098.001").when(k == 1, " es|ql escalation T1098 T1098").when(k == 2, " GuardDuty high IAM").when(
        k == 3, " ServiceNow medium").when(k == 4, " cloudtrail exfil LOW critical").otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"), F.concat("text", extra).alias("content"))


FLAGGED = """f AS (SELECT doc_id, text || CASE doc_id % 10 WHEN 0 THEN ' Containment TA0001 T1098.001' WHEN 1 THEN ' es|ql escalation T1098 T1098' WHEN 2 THEN ' GuardDuty high IAM'
  WHEN 3 THEN ' ServiceNow medium' WHEN 4 THEN ' cloudtrail exfil LOW critical' ELSE '' END AS content FROM documents)"""


@query("k02_tag_chunks", f"""WITH {FLAGGED} SELECT doc_id, concat_ws(',', 'kb', CASE WHEN regexp_matches(content, '(?i)containment|remediation') THEN 'remediation' END,
  CASE WHEN regexp_matches(content, '(?i)ES[|]QL|esql|FROM logs') THEN 'esql-query' END, CASE WHEN content ILIKE '%escalat%' THEN 'escalation' END,
  CASE WHEN regexp_matches(content, '(?i)MITRE|ATT&CK|TA[0-9]{{4}}|T[0-9]{{4}}') THEN 'mitre-attack' END, CASE WHEN regexp_matches(content, '(?i)IAM|PrivEsc|privilege') THEN 'iam' END,
  CASE WHEN content ILIKE '%guardduty%' THEN 'guardduty' END, CASE WHEN content ILIKE '%exfil%' THEN 'exfiltration' END, CASE WHEN content ILIKE '%cloudtrail%' THEN 'cloudtrail' END,
  CASE WHEN regexp_matches(content, '(?i)ServiceNow|CMDB') THEN 'cmdb' END) AS tags FROM f""")
def _(spark, sf):
    return kb.tag_chunks(flagged(spark, sf), ["kb"]).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("k03_chunk_severity", rf"""WITH {FLAGGED} SELECT doc_id, CASE WHEN content ILIKE '%critical%' THEN 'critical' WHEN regexp_matches(content, '(?i)\bHigh\b') THEN 'high'
  WHEN regexp_matches(content, '(?i)\bMedium\b') THEN 'medium' WHEN regexp_matches(content, '(?i)\bLow\b') THEN 'low' END AS severity FROM f""")
def _(spark, sf):
    return kb.chunk_severity(flagged(spark, sf)).select("doc_id", "severity")


@query("k04_extract_mitre", rf"""WITH {FLAGGED} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'TA[0-9]{{4}}'))), ',') AS tactics,
  array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'T[0-9]{{4}}(?:[.][0-9]{{3}})?'))), ',') AS techniques FROM f""")
def _(spark, sf):
    out = kb.extract_mitre(flagged(spark, sf))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select("doc_id", text("mitre_tactic").alias("tactics"), text("mitre_technique").alias("techniques"))


@query("k05_category_counts", f"""WITH {CHUNKS}, w AS (SELECT category FROM c UNION ALL SELECT category FROM v_markdown WHERE doc_id NOT IN (SELECT doc_id FROM c) AND length(content) > 50)
  SELECT category, count(*) AS chunks FROM w GROUP BY 1""")
def _(spark, sf):
    return kb.category_counts(chunks(spark, sf))


SEARCH = "the heed onthe"


@query("k06_keyword_search", r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
  t AS (SELECT doc_id, len(w) AS length, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'heed')) AS t1,
    len(list_filter(w, lambda x: x = 'onthe')) AS t2 FROM d),
  g AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1, count(*) FILTER (WHERE t2 > 0) AS d2 FROM t)
  SELECT doc_id, round(ln(1 + (n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * t0 * 2.2::DOUBLE / (t0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))
    + ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * t1 * 2.2::DOUBLE / (t1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))
    + ln(1 + (n - d2 + 0.5::DOUBLE) / (d2 + 0.5::DOUBLE)) * t2 * 2.2::DOUBLE / (t2 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)), 6) AS score
  FROM t, g WHERE t0 + t1 + t2 > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def _(spark, sf):
    return kb.keyword_search(table(spark, sf, "documents"), SEARCH, 20, text="text", id_col="doc_id")


@query("k07_vector_search", """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score
  FROM embeddings ORDER BY score DESC, vec_id LIMIT 20""")
def _(spark, sf):
    df = table(spark, sf, "embeddings")
    probe = df.filter("vec_id = 0").select("embedding").first()
    return kb.vector_search(df, list(probe["embedding"]) if probe else [0.0], 20)


@query("k08_rule_guides", """SELECT doc_id AS rule_id, 'IAM PrivEsc ' || source AS title, text AS content, 'aws,' || lang || ',iam' AS tags, 'high' AS severity FROM documents WHERE length(text) >= 30""")
def _(spark, sf):
    rule = lambda name, note, id_: F.struct(
        name.alias("name"), note.alias("note"), F.array("lang").alias("tags"), F.lit("high").alias("severity"), F.lit(73).alias("risk_score"), id_.cast("string").alias("rule_id"))
    rules = F.array(rule(F.concat(F.lit("IAM PrivEsc "), "source"), F.col("text"), F.col("doc_id")), rule(F.lit("GuardDuty"), F.col("lang"), F.col("doc_id")))
    out = kb.rule_guides(table(spark, sf, "documents").select("source", rules.alias("rules")), "aws", ["aws"])
    return out.select(F.col("rule_id").cast("bigint").alias("rule_id"), "title", "content", F.array_join("tags", ",").alias("tags"), "severity")


@query("k09_log_search", """SELECT id, ts, message FROM v_logs WHERE dataset LIKE 'aws.%' AND message ILIKE '%adminrole%' ORDER BY ts DESC, id LIMIT 50""")
def _(spark, sf):
    return kb.log_search(logs(spark, sf), ["aws.*"], "AdminRole", 50).select("id", "ts", "message")


# ---- data quality ---------------------------------------------------------------------------------------------


def docs(spark, sf):
    """Log documents as JSON text with one kind of fault per residue of k."""
    text = F.format_string(
        '{%s"cloud":{"provider":"%s"},"event":{"category":%s,"type":%s,"outcome":"%s"},"message":%s}',
        F.when(F.col("k") % 6 == 0, "").otherwise(F.lit('"@timestamp":"2024-01-01T00:00:00Z",')), F.when(F.col("k") % 6 == 1, "other").otherwise(F.col("vendor")),
        F.when(F.col("k") % 6 == 2, '"iam"').otherwise('["iam"]'), F.when(F.col("k") % 6 == 2, "7").otherwise('["info"]'),
        F.when(F.col("k") % 6 == 3, "odd").otherwise("success"), F.when(F.col("k") % 6 == 4, "5").otherwise('"text"'),
    )
    return logs(spark, sf).select("id", "k", "vendor", "dataset", text.alias("doc"))


FAULTS = "CASE k % 6 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'provider' WHEN 2 THEN 'category_array,type_array' WHEN 3 THEN 'outcome' WHEN 4 THEN 'message_text' ELSE '' END"


@query("v01_log_contract", f"SELECT id, {FAULTS} AS violations FROM v_logs")
def _(spark, sf):
    return q.log_contract(docs(spark, sf)).select("id", F.array_join("violations", ",").alias("violations"))


@query("v02_metric_contract", "SELECT id, CASE k % 3 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'stream_type,outcome' ELSE '' END AS violations FROM v_logs")
def _(spark, sf):
    k = F.col("k") % 3
    text = F.format_string('{%s"data_stream":{"type":"%s"},"event":{"outcome":"%s"}}', F.when(k == 0, "").otherwise('"@timestamp":"t",'),
                           F.when(k == 1, "logs").otherwise("metrics"), F.when(k == 1, "bad").otherwise("unknown"))
    return q.metric_contract(logs(spark, sf).select("id", text.alias("doc"))).select("id", F.array_join("violations", ",").alias("violations"))


@query("v03_ip_contract", """SELECT id, concat_ws(',', CASE WHEN k = 0 OR k > 54 THEN 'a' END, CASE WHEN user_id % 300 > 254 OR user_id % 300 = 0 THEN 'b' END) AS violations FROM v_logs""")
def _(spark, sf):
    df = logs(spark, sf).select(
        "id", F.when(F.col("k") == 0, "0.1.1.1").when(F.col("k") > 54, F.concat(F.col("k") + 200, F.lit(".1.1.1"))).otherwise("10.0.0.1").alias("a"),
        F.concat(F.col("user_id") % 300, F.lit(".2.3.4")).alias("b"),
    )
    return q.ip_contract(df, ["a", "b"]).select("id", F.array_join("violations", ",").alias("violations"))


@query("v04_resource_id_contract", """SELECT id, CASE k % 3 WHEN 0 THEN 'i-' || substr(md5(CAST(id AS VARCHAR)), 1, 16) || 'Z' ELSE '' END AS violations FROM v_logs""")
def _(spark, sf):
    h = F.md5(F.col("id").cast("string"))
    text = F.concat(F.lit("x i-"), F.substring(h, 1, 16), F.when(F.col("k") % 3 == 0, "Z").otherwise("a"), F.lit(" vol-"), F.substring(h, 1, 17), F.lit(" sg-short"))
    return q.resource_id_contract(logs(spark, sf).select("id", text.alias("t")), "t").select("id", F.array_join("violations", ",").alias("violations"))


@query("v05_embedded_metrics", """SELECT id, CASE k % 8 WHEN 0 THEN 'top-level metrics' WHEN 1 THEN 'aws.emr.metrics' WHEN 2 THEN 'aws.rds.read_io' WHEN 3 THEN 'message.metrics'
  WHEN 4 THEN 'jsonPayload.metrics' WHEN 5 THEN 'gcp.gke.metrics' END AS found FROM v_logs""")
def _(spark, sf):
    k = F.col("k") % 8
    text = (
        F.when(k == 0, '{"metrics":{"a":1}}').when(k == 1, '{"aws":{"dimensions":{"metrics":{}},"emr":{"metrics":{"x":1}}}}').when(k == 2, '{"aws":{"rds":{"read_io":1}}}')
        .when(k == 3, '{"message":"{\\"metrics\\":{\\"a\\":1}}"}').when(k == 4, '{"jsonPayload":{"metrics":[1]}}').when(k == 5, '{"gcp":{"gke":{"metrics":{"x":1}}}}')
        .when(k == 6, '{"message":"plain","metrics":5}').otherwise("no json")
    )
    return q.embedded_metrics(logs(spark, sf).select("id", text.alias("doc"))).select("id", "found")


@query("v06_enriched_contract", """SELECT id, concat_ws(',', CASE WHEN vendor <> 'aws' THEN 'provider' END, CASE WHEN k % 3 = 0 THEN 'log_group' END, CASE WHEN k % 5 = 0 THEN 'module' END) AS violations FROM v_logs""")
def _(spark, sf):
    df = logs(spark, sf).select(
        "id", F.col("vendor").alias("cloud.provider"), F.when(F.col("k") % 3 != 0, "g").alias("aws.cloudwatch.log_group"), F.lit("s").alias("aws.cloudwatch.log_stream"),
        F.lit("logs").alias("data_stream.type"), F.col("dataset").alias("data_stream.dataset"), F.when(F.col("k") % 5 != 0, "aws").alias("event.module"), F.col("dataset").alias("event.dataset"),
    )
    return q.enriched_contract(df).select("id", F.array_join("violations", ",").alias("violations"))


@query("v07_chain_contract", """WITH r AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN role WHEN conv_id % 7 = 1 AND turn = 1 THEN NULL ELSE 'run' END AS label,
    NOT (conv_id % 11 = 2 AND turn = 0) AS timed FROM conversations),
  c AS (SELECT conv_id, count(*) AS "rows", count(DISTINCT label) AS labels, count(*) - count(label) AS unlabelled, CAST(sum(CASE WHEN timed THEN 0 ELSE 1 END) AS BIGINT) AS untimed FROM r GROUP BY 1)
  SELECT *, "rows" >= 2 AND labels = 1 AND unlabelled = 0 AND untimed = 0 AS valid FROM c""")
def _(spark, sf):
    label = F.when(F.col("conv_id") % 5 == 0, F.col("role")).when((F.col("conv_id") % 7 == 1) & (F.col("turn") == 1), F.lit(None)).otherwise("run")
    ts = F.when(~((F.col("conv_id") % 11 == 2) & (F.col("turn") == 0)), F.timestamp_seconds("turn"))
    return q.chain_contract(table(spark, sf, "conversations").select("conv_id", label.alias("label"), ts.alias("ts")), "conv_id", "label")


@query("v08_dataset_coverage", """WITH n AS (SELECT DISTINCT CASE user_id % 5 WHEN 0 THEN 'azure.entra_id' WHEN 1 THEN 'azure.firewall' WHEN 2 THEN 'gcp.loadbalancing' WHEN 3 THEN 'aws.x' ELSE dataset END AS dataset FROM v_logs)
  SELECT dataset, dataset IN ('azure.entra_id', 'gcp.loadbalancing', 'aws.cloudtrail', 'gcp.audit') AS covered FROM n""")
def _(spark, sf):
    u = F.col("user_id") % 5
    ds = F.when(u == 0, "azure.entra_id").when(u == 1, "azure.firewall").when(u == 2, "gcp.loadbalancing").when(u == 3, "aws.x").otherwise(F.col("dataset"))
    official = spark.createDataFrame([("azure.auditlogs",), ("gcp.loadbalancing_logs",), ("aws.cloudtrail",), ("gcp.audit",)], "dataset string")
    return q.dataset_coverage(logs(spark, sf).select(ds.alias("dataset")), official, q.alias_table(spark))


@query("v08_labelled_documents", "SELECT d.doc_id AS dataset, l.doc_id IS NOT NULL AS covered FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def _(spark, sf):
    text = lambda t: table(spark, sf, t).select(F.col("doc_id").cast("string").alias("dataset"))
    none = spark.createDataFrame([], "dataset string, aliases array<string>")
    return q.dataset_coverage(text("documents"), text("labels"), none).withColumn("dataset", F.col("dataset").cast("bigint"))


@query("v09_registry_diff", """SELECT doc_id AS id, 'left_only' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 'right_only' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def _(spark, sf):
    return q.registry_diff(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("v10_metric_field_profile", """SELECT service_key, metric, count(*) AS points, TRUE AS has_avg, bool_or(metric <> 'messages') AS has_sum, TRUE AS has_count, bool_or(amount % 2 = 0) AS has_min, FALSE AS has_max,
  metric IN ('request/error_count', 'read_bytes') AS counter FROM v_metric_points GROUP BY service_key, metric""")
def _(spark, sf):
    amount = F.col("amount").cast("double")
    stats = F.struct(amount.alias("avg"), F.when(F.col("metric") != "messages", amount).alias("sum"), F.lit(1).alias("count"),
                     F.when(F.col("amount") % 2 == 0, amount).alias("min"), F.lit(None).cast("double").alias("max"))
    return q.metric_field_profile(view(spark, sf, "metric_points").select("service_key", "metric", stats.alias("stats")))


@query("v11_violations_summary", f"""SELECT dataset, "check", count(*) AS violations FROM (SELECT dataset, unnest(string_split({FAULTS}, ',')) AS "check" FROM v_logs) WHERE "check" <> '' GROUP BY 1, 2""")
def _(spark, sf):
    return q.violations_summary(q.log_contract(docs(spark, sf)))
