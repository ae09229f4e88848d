"""Trace documents: conversion to OTLP spans, service map, integrity checks and correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import field, fill
from skyledger.functions.joins import checked_broadcast, salted_left_join
from skyledger.operators.anomalies import high_mean
from skyledger.session import cut_lineage

# OTLP numbers of span kinds.
SPAN_KINDS = {"INTERNAL": 1, "SERVER": 2, "CLIENT": 3, "PRODUCER": 4, "CONSUMER": 5}
# Span subtypes of messaging systems, and span types of outbound calls.
MESSAGING_SUBTYPES = ("sns", "sqs", "kafka", "kinesis", "eventbridge")
OUTBOUND_TYPES = ("db", "external", "http", "storage", "aws")

_UNION = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>"


def span_kind_name(type_: Column, subtype: Column, action: Column) -> Column:
    """Kind of a span from its type, subtype and action."""
    type_, subtype, action = (F.coalesce(c, F.lit("")) for c in (type_, subtype, action))
    receiving = action.rlike("(?i)receiv|consume|process|poll")
    messaging = (type_ == "messaging") | subtype.isin(*MESSAGING_SUBTYPES)
    outbound = type_.isin(*OUTBOUND_TYPES) | (subtype != "")
    return F.when(messaging & receiving, "CONSUMER").when(messaging, "PRODUCER").when(outbound, "CLIENT").otherwise("INTERNAL")


def http_status(result: Column) -> Column:
    """HTTP status of a transaction result that is one; other results have none."""
    return F.when(result.rlike("^[1-5][0-9]{2}$"), result.try_cast("int"))


def iso_to_unix_nano(text: Column) -> Column:
    """ISO timestamp as decimal nanoseconds with millisecond precision; an invalid one reads 0."""
    ms = F.unix_millis(F.try_to_timestamp(text))
    return F.coalesce(F.concat(ms.cast("string"), F.lit("000000")), F.lit("0"))


def typed_attributes(values: Column) -> Column:
    """Attributes of a JSON object (text) as key and tagged value, without NULL and empty ones."""
    entries = F.map_entries(F.from_json(values, "map<string,variant>"))

    def tagged(e: Column) -> Column:
        v = e.getField("value")
        kind = F.schema_of_variant(v)
        number = F.try_variant_get(v, "$", "double")
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        whole = numeric & (number == F.floor(number))
        flag = kind == "BOOLEAN"
        return F.struct(
            e.getField("key").alias("key"),
            F.struct(
                F.when(~numeric & ~flag, F.try_variant_get(v, "$", "string")).alias("stringValue"),
                F.when(flag, F.try_variant_get(v, "$", "boolean")).alias("boolValue"),
                F.when(whole, number.try_cast("bigint").cast("string")).alias("intValue"),
                F.when(numeric & ~whole, number).alias("doubleValue"),
            ).alias("value"),
        )

    kept = F.filter(entries, lambda e: F.coalesce(F.try_variant_get(e.getField("value"), "$", "string"), F.lit("")) != "")
    return F.transform(kept, tagged)


def _attribute(key: str, value: Column, integer: bool = False) -> Column:
    slot = "intValue" if integer else "stringValue"
    parts = [F.when(value.isNotNull() & (value.cast("string") != ""), value.cast("string")).alias(slot)]
    blank = {"stringValue": "string", "boolValue": "boolean", "intValue": "string", "doubleValue": "double"}
    ordered = [parts[0] if n == slot else F.lit(None).cast(t).alias(n) for n, t in blank.items()]
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.struct(F.lit(key).alias("key"), F.struct(*ordered).alias("value")))


def span_attributes(df: DataFrame) -> Column:
    """Labels first, then the derived attributes a label does not already carry."""
    labels = field(df, "labels", "map<string,string>")
    have = lambda key, value: F.when(F.coalesce(F.try_element_at(labels, F.lit(key)), F.lit("")) == "", value)
    is_span = field(df, "kind") == "span"
    type_, subtype = F.coalesce(field(df, "type"), F.lit("")), F.coalesce(field(df, "subtype"), F.lit(""))
    outbound = is_span & type_.isin("external", "http")
    derived = [
        _attribute("db.system", have("db.system", F.when(is_span & ((type_ == "db") | (subtype != "")), subtype))),
        _attribute("db.operation", have("db.operation", F.when(is_span, field(df, "action")))),
        _attribute("rpc.system", have("rpc.system", F.when(outbound, F.lit("aws-api")))),
        _attribute("peer.service", have("peer.service", F.when(is_span, field(df, "peer")))),
        _attribute("http.response.status_code", have("http.response.status_code", F.when(~is_span, http_status(field(df, "result")))), integer=True),
    ]
    shown = F.transform(
        F.filter(F.map_entries(labels), lambda e: F.coalesce(e.getField("value"), F.lit("")) != ""),
        lambda e: F.struct(e.getField("key").alias("key"), F.struct(
            e.getField("value").alias("stringValue"), F.lit(None).cast("boolean").alias("boolValue"),
            F.lit(None).cast("string").alias("intValue"), F.lit(None).cast("double").alias("doubleValue"),
        ).alias("value")),
    )
    type_ddl = f"array<struct<key:string,value:{_UNION}>>"
    return F.concat(F.coalesce(shown.cast(type_ddl), F.array().cast(type_ddl)), F.array_compact(F.array(*derived)).cast(type_ddl))


def _start_nanos() -> Column:
    """Start in nanoseconds as text; ``0`` without a time."""
    start = F.coalesce(F.unix_millis("ts"), F.lit(0)) * F.lit(1_000_000)
    return F.when(start == 0, "0").otherwise(start.cast("string"))


def apm_to_otlp_span(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One OTLP span per trace document."""
    is_span = F.col("kind") == "span"
    stated = F.create_map(*[c for k, v in SPAN_KINDS.items() for c in (F.lit(k), F.lit(v))])
    kind = F.coalesce(
        F.when(is_span, F.try_element_at(stated, field(df, "span_kind"))),
        F.when(~is_span, F.when(field(df, "type") == "messaging", SPAN_KINDS["CONSUMER"]).otherwise(SPAN_KINDS["SERVER"])),
        F.lit(SPAN_KINDS["INTERNAL"]),
    )
    start = F.coalesce(F.unix_millis("ts"), F.lit(0)) * F.lit(1_000_000)
    length = F.greatest(F.coalesce(F.round(field(df, "duration_us", "bigint").cast("double")), F.lit(0.0)), F.lit(0.0)).cast("bigint") * 1000
    outcome, error = field(df, "outcome"), field(df, "error_message")
    failed = (outcome == "failure") | error.isNotNull()
    code = F.when(failed, 2).when(outcome == "success", 1).otherwise(0)
    message = F.when(failed, fill(error, F.try_element_at(field(df, "labels", "map<string,string>"), F.lit("error.message"))))
    parent = F.col("parent_id")
    return df.select(
        *(keep or []),
        F.coalesce("trace_id", F.lit("")).alias("traceId"),
        F.coalesce("span_id", "tx_id", F.lit("")).alias("spanId"),
        F.when(parent != "", parent).alias("parentSpanId"),
        F.coalesce("name", field(df, "action"), F.lit("span")).alias("name"),
        kind.alias("kind"),
        _start_nanos().alias("startTimeUnixNano"),
        (start + length).cast("string").alias("endTimeUnixNano"),
        span_attributes(df).alias("attributes"),
        F.struct(code.alias("code"), message.alias("message")).alias("status"),
    )


#: Spans that one task builds and nests, about.
TASK_SPANS = 100_000


def group_resource_spans(df: DataFrame, max_spans: int = 250, scope_version: str = "1.0.0") -> DataFrame:
    """Export requests: spans nested below their resource (service and environment).

    A service may own a third of all spans, so its spans are dealt by hash into batches of about ``max_spans``; a batch,
    never a whole service, meets in one task.  The resource is that of the service's earliest document; attributes it lacks are left out.
    """
    keyed = df.withColumns({"__s": F.coalesce("service", F.lit("unknown")), "__e": F.coalesce("environment", F.lit(""))})
    shown = {
        "service.name": F.col("service"), "service.version": field(df, "service_version"), "deployment.environment": F.col("environment"),
        "telemetry.sdk.name": F.coalesce(field(df, "sdk_name"), F.lit("opentelemetry")),
        "telemetry.sdk.language": F.coalesce(field(df, "sdk_language"), field(df, "service_language")), "telemetry.sdk.version": field(df, "sdk_version"),
        "telemetry.distro.name": field(df, "distro_name"), "telemetry.distro.version": field(df, "distro_version"),
        "cloud.provider": F.coalesce(field(df, "vendor"), F.lit("aws")), "cloud.region": field(df, "region"), "cloud.account.id": field(df, "account"),
        "process.runtime.name": field(df, "runtime_name"), "process.runtime.version": field(df, "runtime_version"),
    }
    first = F.struct(*[v.alias(k) for k, v in shown.items()])
    resource = keyed.groupBy("__s", "__e").agg(F.count("*").alias("__n"), F.min_by(first, F.struct("ts", F.coalesce("span_id", "tx_id"))).alias("__r"))
    # Documents are moved as they are, and only once if the resources are few; spans, several times as wide, are built where their batch is.
    keys = ["__s", "__e"]
    resource = cut_lineage(resource)
    total = resource.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    marked = checked_broadcast(resource)
    batches = F.greatest(F.ceil(F.col("__n") / F.lit(max_spans)), F.lit(1))
    node, start = F.coalesce("span_id", "tx_id", F.lit("")), _start_nanos()
    batch = F.pmod(F.xxhash64(F.coalesce("trace_id", F.lit("")), node, start), batches)
    if marked is resource:
        dealt = salted_left_join(keyed.withColumn("__id", node), resource, keys, "__id").withColumn("batch", batch)
    else:
        dealt = keyed.join(F.broadcast(resource.select(*keys, "__n")), keys, "left").withColumn("batch", batch)
    dealt = dealt.drop("__n", "__id").repartition(math.ceil(total / TASK_SPANS) or 1, *keys, "batch")
    if marked is not resource:
        dealt = dealt.join(F.broadcast(resource.select(*keys, "__r")), keys, "left")
    spans = apm_to_otlp_span(dealt, keep=[*keys, "batch", "__r"])
    fields = [c for c in spans.columns if c not in (*keys, "batch", "__r")]
    grouped = spans.groupBy(*keys, "batch").agg(
        F.collect_list(F.struct(*fields)).alias("spans"), F.first("__r").alias("__r")
    )
    attributes = F.array_compact(F.array(*[_attribute(k, F.col(f"__r.`{k}`")) for k in shown]))
    scope = F.struct(F.struct(F.col("__r.`telemetry.sdk.name`").alias("name"), F.lit(scope_version).alias("version")).alias("scope"), F.col("spans"))
    return grouped.select(
        F.col("__s").alias("service"), F.col("__e").alias("environment"), "batch",
        F.struct(F.struct(attributes.alias("attributes")).alias("resource"), F.array(scope).alias("scopeSpans")).alias("resourceSpans"),
    )


def otlp_requests(batches: DataFrame) -> DataFrame:
    """Export batches as OTLP/JSON text, one request per row."""
    return batches.select(F.to_json(F.struct(F.array("resourceSpans").alias("resourceSpans"))).alias("value"))


def service_map(df: DataFrame) -> DataFrame:
    """Caller to callee edges between services with calls, failures and mean duration."""
    node = F.coalesce("span_id", "tx_id")
    parents = df.select(F.col("trace_id").alias("__t"), node.alias("__id"), F.col("service").alias("caller"))
    children = df.filter(F.col("parent_id").isNotNull())
    joined = children.join(parents, (F.col("trace_id") == F.col("__t")) & (F.col("parent_id") == F.col("__id")))
    return joined.groupBy("caller", F.col("service").alias("callee")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("outcome") == "failure").alias("failures"), F.avg("duration_us").alias("mean_us")
    )


def trace_integrity(df: DataFrame) -> DataFrame:
    """Per trace: documents, roots, unresolved parents, and whether it has one root, no orphan and two documents.

    Ids and references meet in one aggregate per (trace, id), which replaces the self-join.
    """
    node = F.struct(F.coalesce("span_id", "tx_id").alias("id"), F.lit(1).alias("is_node"), F.lit(0).alias("refs"), F.col("parent_id").isNull().cast("int").alias("root"))
    ref = F.when(F.col("parent_id").isNotNull(), F.struct(F.col("parent_id").alias("id"), F.lit(0).alias("is_node"), F.lit(1).alias("refs"), F.lit(0).alias("root")))
    rows = df.select("trace_id", F.explode(F.array_compact(F.array(node, ref))).alias("r")).select("trace_id", "r.*")
    per_id = rows.groupBy("trace_id", "id").agg(F.sum("is_node").alias("nodes"), F.sum("refs").alias("refs"), F.sum("root").alias("roots"))
    out = per_id.groupBy("trace_id").agg(
        F.sum("nodes").alias("docs"), F.sum("roots").alias("roots"), F.sum(F.when(F.col("nodes") == 0, F.col("refs")).otherwise(0)).alias("orphans")
    )
    return out.withColumn("valid", (F.col("docs") >= 2) & (F.col("roots") == 1) & (F.col("orphans") == 0))


def error_doc_integrity(errors: DataFrame) -> DataFrame:
    """Names of the checks an error document fails, comma-separated; empty when it is sound."""
    first = F.try_element_at("exception", F.lit(1))
    checks = {
        "stream_type": F.col("stream_type") == "logs",
        "dataset": F.col("dataset") == "apm.error",
        "trace_id": F.length("trace_id") == 32,
        "transaction_id": F.length("tx_id") >= 16,
        "parent_id": F.length("parent_id") >= 16,
        "error_id": F.length("error_id") == 32,
        "grouping_key": F.col("grouping_key").isNotNull(),
        "exception": F.size("exception") > 0,
        "exception_type": F.length(first.getField("type")) > 0,
        "exception_message": F.length(first.getField("message")) > 0,
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return errors.withColumn("violations", F.array_join(failed, ","))


def apm_error_join(errors: DataFrame, transactions: DataFrame) -> DataFrame:
    """Error documents with the name and result of their transaction."""
    tx = transactions.select("trace_id", "tx_id", F.col("name").alias("tx_name"), F.col("result").alias("tx_result"), F.col("service").alias("tx_service"))
    return errors.join(tx, ["trace_id", "tx_id"], "left")


def span_latency_by_type(spans: DataFrame, span: str = "1 day", **options) -> DataFrame:
    """Mean span duration by type, scored against its own past."""
    return high_mean(spans.filter(F.col("kind") == "span"), "duration_us", ["type"], span=span, **options)


# The stages of a data run, in order.
RUN_STAGES = ("land", "start", "read", "spark", "crawler", "query", "done")


def broken_runs(stages: DataFrame, expected: tuple[str, ...] = RUN_STAGES) -> DataFrame:
    """Runs with a failed stage after which expected stages are absent.

    Stages present fold into a bit set per run, a map-side combined aggregate; no expected-stage join is needed.
    """
    position = F.array_position(F.array(*[F.lit(s) for s in expected]), F.col("stage")).cast("int")
    bit = F.expr("shiftleft(1, pos - 1)")
    rows = stages.withColumn("pos", position).filter(F.col("pos") > 0).withColumn("bit", bit)
    runs = rows.groupBy("run_id").agg(F.bit_or("bit").alias("present"), F.min(F.when(F.col("outcome") == "failure", F.col("pos"))).alias("failed_pos"))
    absent = F.array_compact(F.array(*[
        F.when((F.col("failed_pos") < i + 1) & (F.col("present").bitwiseAND(F.lit(1 << i)) == 0), F.lit(s)) for i, s in enumerate(expected)
    ]))
    named = F.element_at(F.array(*[F.lit(s) for s in expected]), F.col("failed_pos"))
    out = runs.filter(F.col("failed_pos").isNotNull()).select("run_id", named.alias("failed_stage"), F.array_join(absent, ",").alias("missing"))
    return out.filter(F.col("missing") != "")


def log_trace_key(df: DataFrame) -> Column:
    """Trace id of a log row: the last part of a resource name, or an operation id without dashes."""
    gcp = F.regexp_extract(field(df, "gcp_trace"), "traces/([^/]+)$", 1)
    azure = F.substring(F.regexp_replace(field(df, "operation_id"), "-", ""), 1, 32)
    return F.coalesce(F.when(gcp != "", gcp), azure)


def trace_log_join(logs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Log rows with the service of their trace: of its first transaction, so a log stays one row."""
    first = F.min_by(F.struct("service", "name"), F.struct("ts", "tx_id")).alias("__t")
    tx = transactions.groupBy("trace_id").agg(first).select("trace_id", F.col("__t.service").alias("service"), F.col("__t.name").alias("tx_name"))
    return logs.withColumn("trace_id", log_trace_key(logs)).join(tx, "trace_id")
