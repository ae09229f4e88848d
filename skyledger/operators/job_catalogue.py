"""The catalogue of anomaly jobs as data, and a runner that evaluates all of it in one scan.

A job names a stream, a condition, a detector, the field it measures and the field that splits it.  The runner joins rows with the jobs of
their stream, a broadcast of one row per job in code, so the plan stays the same however long the catalogue is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.timebucket import bucket
from skyledger.operators.anomalies import SPAN, rare, score_job_series

# Conditions by name, the fields that they read, and their SQL.
CONDITIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "all": ((), "TRUE"),
    "failure": (("outcome",), "outcome = 'failure'"),
    "severe": (("severity",), "severity IN ('Critical', 'High')"),
    "root": (("user_name",), "user_name = 'root' OR user_name LIKE 'admin-%'"),
    "iam_create": (("action",), "action IN ('CreateAccessKey', 'AttachUserPolicy')"),
    "nxdomain": (("rcode",), "rcode = 'NXDOMAIN'"),
    "cold_start": (("cold_start",), "cold_start"),
    "throttled": (("status_code",), "status_code = 429"),
    "server_error": (("status_code",), "status_code >= 500"),
    "cache_miss": (("cache_status",), "cache_status = 'Miss'"),
    "abandoned": (("disposition",), "disposition = 'abandoned'"),
}

# Job, stream, condition, detector, measured field, splitting field ("-": none).
CATALOGUE_TEXT = """
aws-vpcflow-high-bytes-tx aws.vpcflow all high_sum bytes dst_ip
aws-vpcflow-rare-dest-port aws.vpcflow all rare dst_port -
aws-vpcflow-high-denied-count aws.vpcflow failure high_count - src_ip
aws-guardduty-finding-spike aws.guardduty all high_count - severity
aws-guardduty-rare-finding-type aws.guardduty all rare finding_type -
aws-waf-high-block-rate aws.waf failure high_count - src_ip
aws-cloudtrail-rare-user-action aws.cloudtrail all rare action user_name
aws-securityhub-critical-finding-spike aws.securityhub severe high_count - -
aws-macie-finding-spike aws.macie all high_count - bucket_name
aws-inspector-critical-vuln-spike aws.inspector all high_mean additional_count host
aws-config-noncompliance-spike aws.config failure high_count - -
aws-kms-unusual-operation aws.kms all rare action account
aws-securitylake-ocsf-finding-spike aws.securitylake severe high_count - class_uid
aws-securitylake-rare-ocsf-class aws.securitylake all rare class_uid -
aws-lambda-error-spike aws.lambda failure high_count - resource
aws-lambda-duration-anomaly aws.lambda all high_mean duration_ms resource
aws-lambda-throttle-spike aws.lambda all high_mean throttles resource
aws-ec2-cpu-anomaly aws.ec2 all high_mean cpu_pct host
aws-ec2-network-spike aws.ec2 all high_sum bytes host
aws-eks-pod-failure-spike aws.eks failure high_count - namespace
aws-eks-rare-image aws.eks all rare image -
aws-ecs-memory-pressure aws.ecs all high_mean memory_pct resource
aws-ecs-task-failure-spike aws.ecs failure high_count - resource
aws-autoscaling-rapid-scaling aws.autoscaling all high_mean scaling_events resource
aws-beanstalk-5xx-spike aws.beanstalk all high_mean server_errors resource
aws-beanstalk-latency-p99-anomaly aws.beanstalk all high_mean latency_p99 resource
aws-alb-5xx-spike aws.alb server_error high_count - resource
aws-alb-response-time-anomaly aws.alb all high_mean duration_ms -
aws-alb-rare-user-agent aws.alb all rare user_agent -
aws-apigateway-logs-latency-anomaly aws.apigateway all high_mean duration_ms resource
aws-apigateway-error-spike aws.apigateway failure high_count - resource
aws-cloudfront-error-rate-spike aws.cloudfront server_error high_count - -
aws-cloudfront-cache-miss-spike aws.cloudfront cache_miss high_count - -
aws-route53-nxdomain-spike aws.route53 nxdomain high_count - -
aws-networkfirewall-drop-spike aws.networkfirewall failure high_count - -
aws-rds-latency-anomaly aws.rds all high_mean duration_ms resource
aws-rds-connection-spike aws.rds all high_count - resource
aws-aurora-replica-lag aws.aurora all high_mean replica_lag resource
aws-aurora-serverless-capacity aws.aurora all high_max capacity_units resource
aws-elasticache-hit-rate-drop aws.elasticache all low_mean hit_rate resource
aws-elasticache-latency-spike aws.elasticache all high_mean duration_ms resource
aws-dynamodb-throttle-spike aws.dynamodb all high_mean throttles resource
aws-dynamodb-latency-anomaly aws.dynamodb all high_mean duration_ms resource
aws-redshift-query-duration-anomaly aws.redshift all high_mean duration_ms resource
aws-opensearch-jvm-pressure aws.opensearch all high_mean jvm_pct resource
aws-opensearch-write-rejections aws.opensearch all high_mean write_rejections resource
aws-kinesis-iterator-age-anomaly aws.kinesis all high_mean iterator_age resource
aws-kinesis-throughput-anomaly aws.kinesis all high_sum bytes resource
aws-sqs-message-age-anomaly aws.sqs all high_mean message_age resource
aws-sqs-not-visible-spike aws.sqs all high_count - resource
aws-msk-topic-lag-duration-anomaly aws.msk all high_mean duration_ms topic
aws-msk-failure-spike aws.msk failure high_count - topic
aws-stream-throughput-drop aws.kinesis all low_count - resource
aws-sns-delivery-failure-spike aws.sns all high_mean delivery_failures -
aws-msk-consumer-lag-anomaly aws.msk all high_mean consumer_lag resource
aws-msk-under-replicated-partitions aws.msk all high_mean under_replicated resource
aws-eventbridge-failed-invocations aws.eventbridge all high_mean additional_count rule_name
aws-stepfunctions-execution-failure-spike aws.stepfunctions all high_mean execution_failures resource
aws-glue-job-duration-anomaly aws.glue all high_mean duration_ms dag_id
aws-glue-failure-spike aws.glue failure high_count - dag_id
aws-athena-data-scanned-spike aws.athena all high_sum bytes workgroup
aws-athena-query-duration-anomaly aws.athena all high_mean duration_ms workgroup
aws-emr-task-failure-spike aws.emr all high_mean task_failures resource
aws-spark-stage-duration-anomaly aws.emr all high_mean duration_ms dag_id
aws-spark-executor-loss-rate aws.emr failure high_count - dag_id
aws-spark-gc-pressure aws.emr all high_mean gc_ms executor
aws-spark-shuffle-volume-anomaly aws.emr all high_sum bytes dag_id
aws-spark-task-duration-anomaly aws.emr all high_mean duration_ms stage_id
aws-bedrock-token-usage-spike aws.bedrock all high_sum tokens model_id
aws-bedrock-latency-anomaly aws.bedrock all high_mean duration_ms model_id
aws-bedrock-error-spike aws.bedrock failure high_count - model_id
aws-bedrock-rare-model aws.bedrock all rare model_id -
aws-s3-bandwidth-anomaly aws.s3access all high_sum bytes bucket_name
aws-s3-error-spike aws.s3access failure high_count - bucket_name
aws-s3-rare-operation aws.s3access all rare action -
aws-s3-rare-requester aws.s3access all rare requester -
aws-cloudwatch-alarm-storm aws.cloudwatch all high_count - -
aws-cloudformation-rollback-spike aws.cloudformation failure high_count - -
aws-billing-cost-anomaly aws.billing all high_mean cost account
aws-ssm-rare-command aws.ssm all rare action host
apm-transaction-duration-anomaly apm.transaction all high_mean duration_ms resource
apm-error-rate-spike apm.transaction failure high_count - resource
apm-service-throughput-drop apm.transaction all low_count - resource
apm-slow-span-by-type apm.span all high_mean duration_ms category
apm-lambda-cold-start-spike apm.transaction cold_start high_count - resource
apm-emr-stage-duration-anomaly apm.span all high_mean duration_ms -
aws-apigateway-5xx-error-spike aws.apigateway server_error high_count - resource
aws-apigateway-throttle-spike aws.apigateway throttled high_count - -
aws-apigateway-integration-latency-anomaly aws.apigateway all high_mean integration_latency resource
aws-lambda-cold-start-spike aws.lambda cold_start high_count - resource
aws-codebuild-failure-spike aws.codebuild failure high_count - resource
aws-codebuild-duration-anomaly aws.codebuild all high_mean duration_ms resource
aws-codepipeline-failure-spike aws.codepipeline failure high_count - resource
aws-xray-error-rate-spike aws.xray failure high_count - resource
aws-xray-latency-anomaly aws.xray all high_mean duration_ms resource
aws-iotcore-connection-failure-spike aws.iotcore failure high_count - -
aws-iotcore-message-volume-anomaly aws.iotcore all high_count - -
aws-iotcore-message-volume-anomaly aws.iotcore all low_count - -
aws-iotcore-rule-error-spike aws.iotcore failure high_count - rule_name
aws-iotcore-rare-client aws.iotcore all rare client_id -
aws-mediaconvert-failure-spike aws.mediaconvert failure high_count - resource
aws-connect-contact-abandonment-spike aws.connect abandoned high_count - resource
aws-connect-handle-time-anomaly aws.connect all high_mean duration_ms resource
aws-workspaces-session-failure-spike aws.workspaces failure high_count - -
aws-cloudtrail-rare-source-ip aws.cloudtrail all rare src_ip -
aws-cloudtrail-root-activity aws.cloudtrail root high_count - -
aws-cloudtrail-iam-creation-spike aws.cloudtrail iam_create high_count - -
aws-route53-dns-exfiltration aws.route53 all high_count - qname
aws-nlb-unhealthy-host-spike aws.nlb all high_mean additional_count resource
aws-nlb-tcp-reset-anomaly aws.nlb all high_mean tcp_resets resource
azure-openai-latency-anomaly azure.openai all high_mean duration_ms -
azure-openai-failure-spike azure.openai failure high_count - resource
gcp-vertex-ai-latency-anomaly gcp.vertexai all high_mean duration_ms -
gcp-vertex-ai-failure-spike gcp.vertexai failure high_count - resource
gcp-gemini-error-spike gcp.gemini failure high_count - model_id
gcp-gemini-latency-anomaly gcp.gemini all high_mean duration_ms -
"""


@dataclass(frozen=True)
class CatalogueJob:
    """One anomaly job; ``field`` is what it measures, or for ``rare`` the value that may be rare."""

    id: str
    stream: str
    condition: str
    function: str
    field: str | None
    by: str | None

    @property
    def reads(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*CONDITIONS[self.condition][0], *(c for c in (self.field, self.by) if c)]))


CATALOGUE: tuple[CatalogueJob, ...] = tuple(CatalogueJob(*[None if x == "-" else x for x in line.split()]) for line in CATALOGUE_TEXT.strip().splitlines())


def split_runnable(columns: list[str], jobs: tuple[CatalogueJob, ...] = CATALOGUE) -> tuple[tuple[CatalogueJob, ...], dict[str, tuple[str, ...]]]:
    """The jobs whose fields are all there, and for each other job the fields that it misses."""
    missing = {j: tuple(c for c in j.reads if c not in columns) for j in jobs}
    return tuple(j for j in jobs if not missing[j]), {j.id: m for j, m in missing.items() if m}


def _tagged(df: DataFrame, jobs: tuple[CatalogueJob, ...], stream: str, ts: str) -> DataFrame:
    """Rows with the jobs that they feed: ``ts, job_id, function, partition_value, number, value``."""
    dimension = df.sparkSession.createDataFrame([(j.id, j.stream, j.condition, j.function, j.field, j.by) for j in jobs], "job_id string, __stream string, only string, function string, field string, split string")
    texts = sorted({c for j in jobs for c in (j.by, j.field if j.function == "rare" else None) if c})
    numbers = sorted({j.field for j in jobs if j.field and j.function != "rare"})
    holds = F.array_compact(F.array(*[F.when(F.expr(CONDITIONS[c][1]), F.lit(c)) for c in sorted({j.condition for j in jobs})]))

    def picked(names: list[str], kind: str, which: str) -> Column:
        entries = [x for c in names for x in (F.lit(c), F.col(c).cast(kind))]
        return F.try_element_at(F.create_map(*entries), F.col(which)) if entries else F.lit(None).cast(kind)

    rows = df.select("*", holds.alias("__holds")).join(F.broadcast(dimension), F.col(stream) == F.col("__stream")).where(F.expr("array_contains(__holds, only)"))
    return rows.select(
        F.col(ts).alias("ts"), "job_id", "function", F.when(F.col("split").isNull(), "*").otherwise(picked(texts, "string", "split")).alias("partition_value"),
        picked(numbers, "double", "field").alias("number"), picked(texts, "string", "field").alias("value"),
    )


def run_catalogue(df: DataFrame, jobs: tuple[CatalogueJob, ...] = CATALOGUE, span: str = SPAN, as_of: str | None = None, stream: str = "dataset", ts: str = "ts") -> DataFrame:
    """All metric jobs that ``df`` has the fields for: job_id, partition value, ts of the bucket, actual, score.

    Counts see empty buckets as zero, with ``as_of`` also those after a partition's last event, so that silence is an anomaly, too.
    """
    able = tuple(j for j in split_runnable(df.columns, jobs)[0] if j.function != "rare")
    rows = _tagged(df, able, stream, ts)
    grouped = rows.groupBy("job_id", "function", "partition_value", bucket("ts", span).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("number").alias("total"), F.avg("number").alias("mean"), F.max("number").alias("top")
    )
    f = F.col("function")
    x = F.when(f == "high_sum", F.col("total")).when(f.isin("high_mean", "low_mean"), F.col("mean")).when(f == "high_max", F.col("top")).otherwise(F.col("n").cast("double"))
    return score_job_series(grouped.select("job_id", "function", "partition_value", "bucket", x.alias("x")), span, as_of)


def run_rare_catalogue(df: DataFrame, jobs: tuple[CatalogueJob, ...] = CATALOGUE, span: str = SPAN, max_share: float = 0.05, stream: str = "dataset", ts: str = "ts") -> DataFrame:
    """All rarity jobs that ``df`` has the fields for: values in a small share of their partition's buckets."""
    able = tuple(j for j in split_runnable(df.columns, jobs)[0] if j.function == "rare")
    return rare(_tagged(df, able, stream, ts), "value", ["job_id", "partition_value"], span, max_share)
