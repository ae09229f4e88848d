"""Fixed values of log normalisation: field names, groups, datasets and patterns that results depend on."""

# Event.kind, event.category and event.type by service group; an unknown group reads as misc.
GROUP_ECS = {
    "analytics": ("event", ["database"], ["info"]),
    "ml": ("event", ["process"], ["info"]),
    "aiml": ("event", ["process"], ["info"]),
    "serverless": ("event", ["process"], ["info"]),
    "compute": ("event", ["host", "process"], ["info"]),
    "databases": ("event", ["database"], ["info"]),
    "storage": ("event", ["file"], ["info"]),
    "security": ("event", ["security"], ["info"]),
    "networking": ("event", ["network"], ["info"]),
    "streaming": ("event", ["process"], ["info"]),
    "iot": ("event", ["host"], ["info"]),
    "management": ("event", ["configuration"], ["info"]),
    "devtools": ("event", ["process"], ["info"]),
    "enduser": ("event", ["session"], ["info"]),
    "media": ("event", ["process"], ["info"]),
    "datawarehouse": ("event", ["database"], ["info"]),
    "containers": ("event", ["process"], ["info"]),
    "integration": ("event", ["process"], ["info"]),
    "data-ai": ("event", ["database"], ["info"]),
    "serverless-apps": ("event", ["process"], ["info"]),
    "platform": ("event", ["configuration"], ["info"]),
    "resilience-migration": ("event", ["configuration"], ["info"]),
    "identity-security": ("event", ["iam"], ["info"]),
    "iot-media": ("event", ["host"], ["info"]),
    "ai": ("event", ["process"], ["info"]),
    "misc": ("event", ["process"], ["info"]),
}

# Which parsed key fills which target, by service group, in order of precedence.
# A target with a leading dot belongs to the service's own namespace.
_ANALYTICS = [
    ("jobId", ".job_id"), ("job_id", ".job_id"), ("jobName", ".job_name"), ("job_name", ".job_name"), ("state", ".state"),
    ("status", ".status"), ("query", ".query"), ("records_processed", ".records_processed"),
    ("bytes_scanned", ".bytes_scanned"),
]
_SERVERLESS = [
    ("function_name", ".function_name"), ("functionName", ".function_name"), ("request_id", ".request_id"),
    ("requestId", ".request_id"), ("cold_start", ".cold_start"), ("memory_used", ".memory_used_mb"),
    ("billed_duration_ms", ".billed_duration_ms"),
]
_ML = [
    ("model_id", ".model_id"), ("modelId", ".model_id"), ("endpoint_name", ".endpoint_name"),
    ("input_tokens", ".input_tokens"), ("output_tokens", ".output_tokens"), ("status", ".status"),
    ("inference_latency_ms", ".inference_latency_ms"),
]
_MANAGEMENT = [
    ("action", "event.action"), ("resource_type", ".resource_type"), ("resource_id", ".resource_id"),
    ("stackName", ".stack_name"), ("status", ".status"), ("principal", "user.name"),
]
GROUP_FIELDS = {
    "security": [
        ("severity", ".severity"), ("finding_type", "rule.name"), ("rule_id", "rule.id"),
        ("threat_type", "threat.technique.name"), ("action", "event.action"),
    ],
    "analytics": _ANALYTICS,
    "datawarehouse": _ANALYTICS,
    "data-ai": _ANALYTICS,
    "compute": [
        ("instance_id", "host.id"), ("instanceId", "host.id"), ("state", ".state"), ("status", ".status"),
        ("cpu_utilization", ".cpu_utilization"), ("memory_utilization", ".memory_utilization"),
    ],
    "databases": [
        ("db_instance", ".instance"), ("instance_id", ".instance"), ("query", ".query"), ("operation", ".operation"),
        ("latency", ".latency_ms"), ("connections", ".connections"), ("user", "db.user.name"), ("statement", ".statement"),
    ],
    "networking": [
        ("src_addr", "source.ip"), ("dst_addr", "destination.ip"), ("src_port", "source.port"),
        ("dst_port", "destination.port"), ("protocol", "network.transport"), ("bytes_in", "source.bytes"),
        ("bytes_out", "destination.bytes"), ("action", "event.action"), ("rule_id", "rule.id"),
    ],
    "serverless": _SERVERLESS,
    "serverless-apps": _SERVERLESS,
    "storage": [
        ("bucket", ".bucket"), ("bucket_name", ".bucket"), ("key", ".object_key"), ("object_key", ".object_key"),
        ("operation", "event.action"), ("bytes", ".bytes"), ("size", ".bytes"),
    ],
    "streaming": [
        ("stream_name", ".stream_name"), ("shard_id", ".shard_id"), ("records", ".records"), ("bytes", ".bytes"),
        ("status", ".status"), ("error_code", "error.code"),
    ],
    "ml": _ML,
    "aiml": _ML,
    "iot": [
        ("device_id", ".device_id"), ("deviceId", ".device_id"), ("clientId", ".client_id"), ("topic", ".topic"),
        ("action", "event.action"), ("protocol", "network.protocol"), ("payload_size", ".payload_bytes"),
    ],
    "management": _MANAGEMENT,
    "platform": _MANAGEMENT,
    "devtools": [
        ("build_id", ".build_id"), ("buildId", ".build_id"), ("project", ".project"), ("pipeline", ".pipeline"),
        ("stage", ".stage"), ("phase", ".phase"), ("status", ".status"), ("state", ".state"),
    ],
    "enduser": [
        ("session_id", ".session_id"), ("sessionId", ".session_id"), ("user_id", "user.id"), ("userId", "user.id"),
        ("action", "event.action"), ("status", ".status"),
    ],
    "media": [
        ("job_id", ".job_id"), ("jobId", ".job_id"), ("channel", ".channel"), ("format", ".format"), ("status", ".status"),
        ("bitrate", ".bitrate"),
    ],
    "containers": [
        ("pod_name", "kubernetes.pod.name"), ("namespace", "kubernetes.namespace"), ("container_name", "container.name"),
        ("image", "container.image.name"), ("status", ".status"), ("node", "host.name"),
    ],
    "integration": [
        ("connector_id", ".connector_id"), ("flow_name", ".flow_name"), ("status", ".status"), ("records", ".records"),
        ("error_code", "error.code"),
    ],
}

# Parsed keys that carry a duration, first present one wins, with nanoseconds per unit.
DURATION_KEYS = (
    ("duration_ms", 1_000_000),
    ("durationMs", 1_000_000),
    ("durationSeconds", 1_000_000_000),
    ("latency_ms", 1_000_000),
    ("execution_time_ms", 1_000_000),
    ("elapsed_ms", 1_000_000),
)

# Groups whose plain-text lines may be log4j output.
LOG4J_GROUPS = ("analytics", "compute", "ml", "aiml", "serverless")

# Public grok patterns for ISO timestamps, log levels and Java class names.
ISO_TIMESTAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:?[0-9]{2}(?::?[0-9]{2}(?:[.,:][0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
LOG_LEVEL = (
    "[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|[Ww]arn(?:ing)?|WARN(?:ING)?|"
    "[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL|[Ss]evere|SEVERE|[Ee]merg(?:ency)?|EMERG(?:ENCY)?"
)
JAVA_CLASS = r"(?:[a-zA-Z$_][a-zA-Z$_0-9]*\.)*[a-zA-Z$_][a-zA-Z$_0-9]*"

# The claim that carries an Azure caller's principal name.
UPN_CLAIM = "http://schemas.xmlsoap.org/ws/2005/05/identity/claims/upn"

# ECS versions set by normalisation (always) and by enrichment (when missing).
ECS_VERSION_NORMALISED = "9.3.0"
ECS_VERSION_ENRICHED = "8.11.0"

# Services with a dataset of their own.
DEDICATED_DATASETS = {
    "cloudtrail": "aws.cloudtrail",
    "vpc": "aws.vpcflow",
    "alb": "aws.elb_logs",
    "nlb": "aws.elb_logs",
    "elb": "aws.elb_logs",
    "cloudfront": "aws.cloudfront_logs",
    "waf": "aws.waf",
    "wafv2": "aws.waf",
    "networkfirewall": "aws.firewall_logs",
    "route53": "aws.route53_public_logs",
    "route53resolver": "aws.route53_resolver_logs",
    "s3": "aws.s3access",
    "ec2": "aws.ec2_logs",
    "lambda": "aws.lambda_logs",
    "apigateway": "aws.apigateway_logs",
    "emr": "aws.emr_logs",
    "guardduty": "aws.guardduty",
    "securityhub": "aws.securityhub_findings",
    "inspector": "aws.inspector",
    "config": "aws.config",
    "health": "aws.awshealth",
    "storagelens": "aws.s3_storage_lens",
    "billing": "aws.billing",
}

# Generic dataset by ingestion source, and the default.
GENERIC_DATASETS = {
    "cloudwatch": "aws.cloudwatch_logs",
    "s3": "aws_logs.generic",
    "firehose": "awsfirehose",
    "api": "aws.cloudwatch_logs",
    "agent": "aws.cloudwatch_logs",
    "otel": "aws.cloudwatch_logs",
    "otel-edot-collector": "aws.cloudwatch_logs",
    "otel-csp-edot-gateway": "aws.cloudwatch_logs",
    "fluent-bit": "aws.cloudwatch_logs",
}
DEFAULT_DATASET = "aws.cloudwatch_logs"

# Stale dataset names and further real datasets.
STALE_DATASETS = {
    "aws.ec2": "aws.ec2_logs",
    "aws.s3": "aws.s3access",
    "aws.inspector2": "aws.inspector",
    "aws.route53": "aws.route53_public_logs",
}
OTHER_REAL_DATASETS = (
    "aws.securityhub_insights", "cloud_security_posture.findings", "aws.cloudwatch_logs", "aws_logs.generic", "awsfirehose",
)

# Correlation labels written only by a vendor's own telemetry gateway.
GATEWAY_SOURCE = "otel-csp-edot-gateway"
GATEWAY_LABELS = {
    "aws": ("aws.xray.trace_id", "aws.xray.segment_id", "aws.otel.csp_distro"),
    "gcp": (
        "gcp.cloud_trace.trace_id", "gcp.cloud_trace.span_id", "gcp.google_cloud_otel.propagator", "gcp.otel.csp_distro",
    ),
    "azure": (
        "azure.application_insights.operation_id", "azure.monitor.trace_id", "azure.monitor.span_id",
        "azure.monitor.opentelemetry.dist",
    ),
}
# Labels the gateway always sets.
GATEWAY_CONSTANTS = {
    "aws": {"aws.otel.csp_distro": "ADOT"},
    "gcp": {"gcp.google_cloud_otel.propagator": "cloud_trace_context", "gcp.otel.csp_distro": "otelopscol"},
    "azure": {"azure.monitor.opentelemetry.dist": "Azure Monitor Distro"},
}
OTEL_SOURCES = ("otel", "otel-edot-collector", "otel-csp-edot-gateway")
