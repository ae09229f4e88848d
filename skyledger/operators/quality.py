"""Data-quality contracts and coverage checks.  A contract adds an array of violated check names; empty means sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import any_of
from skyledger.operators.dashboards import is_counter

# Allowed outcomes, private address prefixes, cloud resource id prefixes, database metric names.
OUTCOMES = ("success", "failure", "unknown")
PRIVATE_PREFIXES = ("10.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.3", "192.168.")
RESOURCE_PREFIXES = ("i", "vol", "sg")
DATABASE_METRICS = (
    "database_connections", "read_io", "write_io", "throughput", "replica_lag", "swap_usage", "enhanced_monitoring", "disk_usage",
)
NOT_SERVICES = ("dimensions", "cloudwatch", "rpc")
CLOUDS = ("aws", "gcp", "azure")


def violations(checks: dict[str, Column]) -> Column:
    """Names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def _kind(doc: Column, path: str) -> Column:
    """Type name of the value at a path; NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def _text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def log_contract(df: DataFrame, doc: str = "doc", vendor: str = "vendor") -> DataFrame:
    """Six checks of a log document (JSON text): time, provider, category and type arrays, outcome, message text."""
    rows = df.withColumn("__d", F.try_parse_json(doc))
    d = F.col("__d")
    provider, outcome = _text(d, "$.cloud.provider"), _text(d, "$.event.outcome")
    listy = lambda path: _kind(d, path).isNotNull() & ~_kind(d, path).startswith("ARRAY")
    checks = {
        "timestamp": F.coalesce(_text(d, "$['@timestamp']"), F.lit("")) == "",
        "provider": (provider != "") & (provider != F.col(vendor)),
        "category_array": listy("$.event.category"),
        "type_array": listy("$.event.type"),
        "outcome": _kind(d, "$.event.outcome").isNotNull() & ~F.coalesce(outcome, F.lit("")).isin(*OUTCOMES),
        "message_text": _kind(d, "$.message").isNotNull() & (_kind(d, "$.message") != "STRING"),
    }
    return rows.withColumn("violations", violations(checks)).drop("__d")


def metric_contract(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Time, stream type and outcome of a metric document."""
    rows = df.withColumn("__d", F.try_parse_json(doc))
    d = F.col("__d")
    stream = _text(d, "$.data_stream.type")
    checks = {
        "timestamp": F.coalesce(_text(d, "$['@timestamp']"), F.lit("")) == "",
        "stream_type": (stream != "") & (stream != "metrics"),
        "outcome": _kind(d, "$.event.outcome").isNotNull() & ~F.coalesce(_text(d, "$.event.outcome"), F.lit("")).isin(*OUTCOMES),
    }
    return rows.withColumn("violations", violations(checks)).drop("__d")


def realistic_ip(ip: Column) -> Column:
    """A private prefix, or a first octet between 1 and 254."""
    first = F.regexp_extract(ip, r"^\s*(\d+)", 1).try_cast("int")
    return any_of([ip.startswith(p) for p in PRIVATE_PREFIXES]) | F.coalesce(first.between(1, 254), F.lit(False))


def ip_contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """Address columns that hold an unrealistic address."""
    return df.withColumn("violations", violations({c: F.col(c).isNotNull() & ~realistic_ip(F.col(c)) for c in columns}))


def resource_id_contract(df: DataFrame, text: str) -> DataFrame:
    """Instance, volume and security-group ids of 17 characters that are not hexadecimal."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(rf"\b{p}-[0-9a-zA-Z]{{17}}\b"), F.lit(0)) for p in RESOURCE_PREFIXES]))
    return df.withColumn("violations", F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: ~x.rlike("^[a-z]+-[0-9a-f]+$")))


def embedded_metrics(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Where a log document carries a metric payload; NULL when it does not."""
    top = F.from_json(F.col(doc), "map<string,string>")
    rows = df.withColumn("__m", top)
    m = F.col("__m")
    get = lambda key: F.try_element_at(m, F.lit(key))
    is_object = lambda c: F.coalesce(c.startswith("{") | c.startswith("["), F.lit(False))
    candidates = [F.when(is_object(get("metrics")), F.lit("top-level metrics"))]
    for cloud in CLOUDS:
        services = F.map_filter(
            F.from_json(get(cloud), "map<string,string>"),
            lambda k, v: ~k.isin(*NOT_SERVICES) & F.coalesce(v.startswith("{"), F.lit(False)) & F.get_json_object(v, "$.metrics").isNotNull(),
        )
        name = F.try_element_at(F.map_keys(services), F.lit(1))
        candidates.append(F.concat(F.lit(f"{cloud}."), name, F.lit(".metrics")))
    rds = F.map_keys(F.from_json(F.get_json_object(get("aws"), "$.rds"), "map<string,string>"))
    candidates += [F.when(F.array_contains(rds, f), F.lit(f"aws.rds.{f}")) for f in DATABASE_METRICS]
    candidates.append(F.when(is_object(F.get_json_object(get("message"), "$.metrics")), F.lit("message.metrics")))
    candidates.append(F.when(F.get_json_object(get("jsonPayload"), "$.metrics").isNotNull(), F.lit("jsonPayload.metrics")))
    return rows.withColumn("found", F.coalesce(*candidates)).drop("__m")


def enriched_contract(df: DataFrame) -> DataFrame:
    """Fields an enriched row must have: provider, log group and stream, stream type and dataset, module, event dataset."""
    missing = lambda c: F.col(f"`{c}`").isNull()
    checks = {
        "provider": missing("cloud.provider") | (F.col("`cloud.provider`") != "aws"),
        "log_group": missing("aws.cloudwatch.log_group"),
        "log_stream": missing("aws.cloudwatch.log_stream"),
        "stream_type": missing("data_stream.type") | (F.col("`data_stream.type`") != "logs"),
        "stream_dataset": missing("data_stream.dataset"),
        "module": missing("event.module") | (F.col("`event.module`") != "aws"),
        "event_dataset": missing("event.dataset"),
    }
    return df.withColumn("violations", violations(checks))


def chain_contract(df: DataFrame, chain: str, run_label: str, ts: str = "ts") -> DataFrame:
    """Per chain: at least two rows, one shared run label on every row, a time on every row."""
    out = df.groupBy(chain).agg(
        F.count("*").alias("rows"), F.count_distinct(run_label).alias("labels"), F.count_if(F.col(run_label).isNull()).alias("unlabelled"),
        F.count_if(F.col(ts).isNull()).alias("untimed"),
    )
    ok = (F.col("rows") >= 2) & (F.col("labels") == 1) & (F.col("unlabelled") == 0) & (F.col("untimed") == 0)
    return out.withColumn("valid", ok)


# Datasets that stand in for a differently named official log stream.
DATASET_ALIASES = {
    "gcp.loadbalancing": ["gcp.loadbalancing_logs"],
    "azure.firewall": ["azure.firewall_logs"],
    "azure.spring_apps": ["azure.springcloudlogs"],
    "azure.event_hubs": ["azure.eventhub"],
    "azure.entra_id": ["azure.signinlogs", "azure.auditlogs", "azure.graphactivitylogs", "azure.identity_protection", "azure.provisioning"],
    "azure.policy": ["azure.activitylogs"],
    "azure.monitor": ["azure.platformlogs"],
    "azure.microsoft_365": ["azure.graphactivitylogs"],
}


def alias_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in DATASET_ALIASES.items()], "dataset string, aliases array<string>")


def dataset_coverage(datasets: DataFrame, official: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each dataset and whether it, or any of its aliases, is an official stream."""
    names = datasets.select("dataset").distinct()
    known = official.select(F.col("dataset").alias("official")).distinct()
    own = names.select("dataset", F.col("dataset").alias("official"))
    other = names.join(aliases.select("dataset", F.explode("aliases").alias("official")), "dataset")
    covered = own.unionByName(other).join(known, "official", "left_semi").select("dataset").distinct().withColumn("covered", F.lit(True))
    return names.join(covered, "dataset", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def registry_diff(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Ids of one list that the other lacks, both ways, in one aggregate."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    out = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).filter(F.col("l") != F.col("r"))
    return out.select(key, F.when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))


def metric_field_profile(points: DataFrame) -> DataFrame:
    """Per service and metric: documents, which statistics occur, and whether it reads as a counter."""
    has = lambda s: F.bool_or(F.col(f"stats.{s}").isNotNull()).alias(f"has_{s}")
    out = points.groupBy("service_key", "metric").agg(F.count("*").alias("points"), *[has(s) for s in ("avg", "sum", "count", "min", "max")])
    return out.withColumn("counter", is_counter(F.col("metric"), F.col("has_sum")))


def violations_summary(checked: DataFrame, key: str = "dataset") -> DataFrame:
    """Violations by dataset and check."""
    return checked.select(key, F.explode("violations").alias("check")).groupBy(key, "check").agg(F.count("*").alias("violations"))
