"""Dashboard and triage aggregates: key figures, breakdowns, timelines, top lists and health summaries.

Counts, sums and extremes combine on the map side, so a hot group costs no more than a cold one.  Every top list
ends in ``orderBy(...).limit(n)``, which Spark runs as a distributed top-k, with the keys as tie-break.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import all_of, as_col, percent, wildcard, wildcard_any
from skyledger.functions.ordered import exact_percentiles
from skyledger.functions.timebucket import auto_interval, bucket, lookback

# ---- single figures -------------------------------------------------------------------------------------------


def kpi_count(df: DataFrame, where: Column | None = None, name: str = "value") -> DataFrame:
    """Number of rows, optionally of those that satisfy a condition."""
    return (df if where is None else df.filter(where)).agg(F.count("*").alias(name))


def kpi_count_distinct(df: DataFrame, column: str, not_null: bool = False, approx: bool = False, name: str = "value") -> DataFrame:
    """Distinct values of a column: exact, or a mergeable sketch with ``approx``."""
    kept = df.filter(as_col(column).isNotNull()) if not_null else df
    agg = F.approx_count_distinct(as_col(column)) if approx else F.count_distinct(as_col(column))
    return kept.agg(agg.alias(name))


def kpi(df: DataFrame, fn: str, column: str | Column, digits: int | None = None, scale: float | None = None, name: str = "value") -> DataFrame:
    """SUM / AVG / MIN / MAX of a column, optionally divided by ``scale`` and rounded."""
    value = getattr(F, fn)(as_col(column))
    if scale is not None:
        value = value / F.lit(scale)
    if digits is not None:
        value = F.round(value, digits)
    return df.agg(value.alias(name))


# ---- breakdowns -----------------------------------------------------------------------------------------------


def count_by(df: DataFrame, *keys: str, name: str = "events") -> DataFrame:
    """Rows per key; NULL is a group of its own."""
    return df.groupBy(*[as_col(k) for k in keys]).agg(F.count("*").alias(name))


def aggregate_by(
    df: DataFrame,
    keys: list[str | Column],
    aggs: dict[str, Column],
    where: Column | None = None,
    having: Column | None = None,
    order: list[Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filter, group, aggregate, filter groups, sort, cut: the common shape of panel and triage queries."""
    out = (df if where is None else df.filter(where)).groupBy(*[as_col(k) for k in keys])
    out = out.agg(*[v.alias(k) for k, v in aggs.items()])
    if having is not None:
        out = out.filter(having)
    if order:
        out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


def top_n_by(df: DataFrame, keys: list[str], n: int, where: Column | None = None, name: str = "events") -> DataFrame:
    """The ``n`` most frequent key combinations."""
    return aggregate_by(df, keys, {name: F.count("*")}, where=where, order=[F.desc(name), *[F.asc_nulls_last(k) for k in keys]], limit=n)


def top_n_coalesce(df: DataFrame, key: str, default: str, n: int, name: str = "events") -> DataFrame:
    """Top list in which a missing key counts under a default label."""
    return top_n_by(df.withColumn(key, F.coalesce(as_col(key), F.lit(default))), [key], n, name=name)


# ---- timelines ------------------------------------------------------------------------------------------------


def timeline(df: DataFrame, width: int | str, aggs: dict[str, Column], by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Aggregates per fixed time bucket and optional category."""
    keys = [bucket(ts, width).alias("bucket"), *[as_col(k) for k in by or []]]
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])


def timeline_auto(
    df: DataFrame, start: dt.datetime, end: dt.datetime, aggs: dict[str, Column], target: int = 75, ts: str = "ts"
) -> DataFrame:
    """Timeline over [start, end) whose bucket width is picked so that at most ``target`` buckets result."""
    ranged = df.filter((as_col(ts) >= F.lit(start)) & (as_col(ts) < F.lit(end)))
    return timeline(ranged, auto_interval(start, end, target), aggs, ts=ts)


# ---- row lists ------------------------------------------------------------------------------------------------


def recent_events(df: DataFrame, keep: list[str | Column], n: int, where: Column | None = None, ts: str = "ts", tie: str = "id", ascending: bool = False) -> DataFrame:
    """Chosen columns of the newest (or oldest) ``n`` rows."""
    kept = df if where is None else df.filter(where)
    order = [F.asc(ts), F.asc(tie)] if ascending else [F.desc(ts), F.asc(tie)]
    return kept.orderBy(*order).limit(n).select(*[as_col(k) for k in keep])


def wildcard_filter(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose column matches any wildcard pattern; prefix patterns reach the scan as StartsWith."""
    return df.filter(wildcard_any(column, patterns))


# ---- health and error summaries -------------------------------------------------------------------------------


def filtered_aggregate(df: DataFrame, keys: list[str], condition: Column, part: str = "matching", whole: str = "total") -> DataFrame:
    """Conditional count beside the full count, in one pass."""
    return aggregate_by(df, keys, {whole: F.count("*"), part: F.count_if(condition)})


def error_summary(df: DataFrame, as_of: str, hours: int, n: int = 20) -> DataFrame:
    """Failures by dataset, region and error code."""
    recent = lookback(df, as_of, f"{hours} HOURS")
    return top_n_by(recent, ["dataset", "region", "error_code"], n, where=F.col("outcome") == "failure", name="error_count")


def service_health(df: DataFrame, as_of: str, hours: int, n: int = 20) -> DataFrame:
    """Total, failures and failure percentage per dataset."""
    recent = lookback(df, as_of, f"{hours} HOURS")
    totals = filtered_aggregate(recent, ["dataset"], F.col("outcome") == "failure", part="failures")
    rated = totals.withColumn("error_rate", percent(F.col("failures"), F.col("total")))
    return rated.orderBy(F.desc("error_rate"), "dataset").limit(n)


def top_errors(df: DataFrame, as_of: str, hours: int, n: int = 15) -> DataFrame:
    """Most frequent pairs of error code and message."""
    recent = lookback(df, as_of, f"{hours} HOURS")
    return top_n_by(recent, ["error_code", "message"], n, where=F.col("outcome") == "failure", name="count")


def anomaly_leaderboard(results: DataFrame, job_pattern: str, n: int = 20) -> DataFrame:
    """Highest score and latest time per anomaly job."""
    where = (F.col("anomaly_score") > 0) & wildcard("job_id", job_pattern)
    aggs = {"max_score": F.max("anomaly_score"), "latest": F.max("ts")}
    return aggregate_by(results, ["job_id"], aggs, where=where, order=[F.desc("max_score"), F.asc("job_id")], limit=n)


LATENCY_POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def percentiles(df: DataFrame, keys: list[str], column: str, points: dict[str, float], exact: bool = False, accuracy: int = 10000) -> DataFrame:
    """Percentiles and row count per group: by a mergeable sketch, or exact (interpolated) by distributed ranking."""
    if exact:
        return exact_percentiles(df, keys, column, points)
    aggs = {name: F.percentile_approx(column, p, accuracy) for name, p in points.items()}
    return aggregate_by(df, keys, {**aggs, "throughput": F.count("*")})


def trace_latency(transactions: DataFrame, service_pattern: str, n: int = 20, exact: bool = False) -> DataFrame:
    """p50, p95, p99 and throughput per service."""
    kept = transactions.filter(wildcard("service", service_pattern))
    return percentiles(kept, ["service"], "duration_us", LATENCY_POINTS, exact).orderBy(F.desc("p99"), "service").limit(n)


def runtime_percentiles(runs: DataFrame, min_p95: int = 30000, exact: bool = False) -> DataFrame:
    """Run-time percentiles per workflow, kept where p95 passes the floor."""
    out = percentiles(runs, ["dag_id"], "duration_ms", LATENCY_POINTS, exact).drop("throughput")
    return out.filter(F.col("p95") > min_p95).orderBy(F.desc("p95"), "dag_id")


def finding_summary(df: DataFrame, as_of: str, hours: int, n: int = 20) -> DataFrame:
    """Alerts or configuration events by rule and outcome."""
    where = (F.col("kind") == "alert") | (F.col("category") == "configuration")
    return top_n_by(lookback(df, as_of, f"{hours} HOURS"), ["rule_name", "outcome"], n, where=where, name="count")


def attack_timeline(df: DataFrame, as_of: str, hours: int, n: int = 50) -> DataFrame:
    """Events of attack sessions or of the intrusion category, in time order."""
    where = F.col("session").isNotNull() | (F.col("category") == "intrusion_detection")
    keys = ["action", "dataset", "src_ip", "user_name", "ts"]
    order = [F.asc("ts"), *[F.asc_nulls_last(k) for k in keys[:-1]]]
    return aggregate_by(lookback(df, as_of, f"{hours} HOURS"), keys, {"count": F.count("*")}, where=where, order=order, limit=n)


# The four IAM actions of a privilege-escalation chain, in order.
PRIVESC_ACTIONS = ("ListUsers", "CreateAccessKey", "AttachUserPolicy", "AssumeRole")


def privesc_details(df: DataFrame, as_of: str, hours: int, n: int = 50) -> DataFrame:
    """IAM escalation actions with identity and technique columns."""
    where = (F.col("category") == "iam") & F.col("action").isin(*PRIVESC_ACTIONS)
    keep = ["ts", "action", "user_name", "src_ip", "outcome", "session", "target_user", "tactic", "technique"]
    return recent_events(lookback(df, as_of, f"{hours} HOURS"), keep, n, where=where, ascending=True)


def ip_activity(df: DataFrame, ip: str, as_of: str, hours: int, n: int = 30) -> DataFrame:
    """Everything one address did, across sources."""
    where = F.col("src_ip") == ip
    return top_n_by(lookback(df, as_of, f"{hours} HOURS"), ["dataset", "action", "outcome"], n, where=where, name="actions")


def open_alert_summary(alerts: DataFrame, as_of: str, hours: int, n: int = 30) -> DataFrame:
    """Alerts that have a status other than closed, by rule, severity and risk."""
    where = F.col("status").isNotNull() & (F.col("status") != "closed")
    return top_n_by(lookback(alerts, as_of, f"{hours} HOURS"), ["rule", "severity", "risk"], n, where=where, name="count")


def cmdb_lookup(ci: DataFrame, as_of: str, keep: list[str], n: int = 20) -> DataFrame:
    """Context columns of configuration items seen in the last 30 days, newest first."""
    return recent_events(lookback(ci, as_of, "30 DAYS"), keep, n, tie="ci_id")


def guardduty_summary(df: DataFrame, as_of: str, hours: int, n: int = 20) -> DataFrame:
    """Findings by action, severity and address, most severe first."""
    keys = ["action", "severity_num", "src_ip"]
    order = [F.desc_nulls_last("severity_num"), F.desc("count"), F.asc("action"), F.asc("src_ip")]
    return aggregate_by(lookback(df, as_of, f"{hours} HOURS"), keys, {"count": F.count("*")}, order=order, limit=n)


def empty_ratio_baseline(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Empty and total query results per hour and the reading: up to 1 % normal, from 25 % degraded."""
    out = timeline(df, "1 hour", {"total": F.count("*"), "empty": F.count_if(F.col("rows_returned") == 0)}, ts=ts)
    share = percent(F.col("empty"), F.col("total"))
    return out.withColumn("empty_pct", share).withColumn(
        "reading", F.when(share <= 1, "normal").when(share >= 25, "degraded").otherwise("elevated")
    )


def bad_key_producers(df: DataFrame, extension: str = ".avro") -> DataFrame:
    """Object keys without the expected extension, by requester and bucket."""
    where = ~F.col("object_key").endswith(extension)
    return aggregate_by(df, ["requester", "bucket_name"], {"bad_keys": F.count("*")}, where=where)


# Dynamic-DNS and tunnelling providers watched by the suspicious-domain rule.
SUSPICIOUS_DOMAINS = ("*duckdns.org", "*ngrok.io", "*serveo.net", "*.xyz")


def host_dns_profile(dns: DataFrame, patterns: tuple[str, ...] = SUSPICIOUS_DOMAINS, n: int = 20) -> DataFrame:
    """Suspicious look-ups and unique names per host and address."""
    aggs = {"queries": F.count("*"), "unique_domains": F.count_distinct("qname")}
    order = [F.desc("queries"), F.asc("host"), F.asc("src_ip")]
    return aggregate_by(dns, ["host", "src_ip"], aggs, where=wildcard_any("qname", list(patterns)), order=order, limit=n)


def nxdomain_rate(dns: DataFrame) -> DataFrame:
    """Look-ups and failed look-ups per host."""
    failed = F.when(F.col("rcode") == "NXDOMAIN", 1).otherwise(0)
    return aggregate_by(dns, ["host"], {"total": F.count("*"), "nxdomain": F.sum(failed)})


def egress_by(flows: DataFrame, keys: list[str], min_bytes: int = 52428800, n: int = 25) -> DataFrame:
    """Large outbound flows: bytes and flow count by the given keys."""
    where = (F.col("direction") == "egress") & (F.col("bytes") > min_bytes)
    aggs = {"total_bytes": F.sum("bytes"), "flows": F.count("*")}
    order = [F.desc("total_bytes"), *[F.asc_nulls_last(k) for k in keys]]
    return aggregate_by(flows, keys, aggs, where=where, order=order, limit=n)


def control_failures(findings: DataFrame) -> DataFrame:
    """Failed compliance checks by control."""
    return aggregate_by(findings, ["rule_id"], {"failures": F.count("*")}, where=F.col("evaluation") == "failed")


def eventbridge_failures(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Failed deliveries: count, distinct rules, dead letters and most failed targets by bus, rule, account, region."""
    aggs = {
        "total_failures": F.count("*"),
        "rules_affected": F.count_distinct("rule_name"),
        "dlq_deliveries": F.sum("dead_letters"),
        "max_targets_failed": F.max("targets_failed"),
    }
    order = [F.desc("total_failures"), *[F.asc_nulls_last(k) for k in keys]]
    return aggregate_by(df, keys, aggs, where=F.col("outcome") == "failure", order=order, limit=n)


def domain_stats(dns: DataFrame) -> DataFrame:
    """Volume, spread, first and last sight and failed look-ups per name."""
    aggs = {
        "total_queries": F.count("*"),
        "unique_src_ips": F.count_distinct("src_ip"),
        "first_seen": F.min("ts"),
        "last_seen": F.max("ts"),
        "nxdomain_count": F.count_if(F.col("rcode") == "NXDOMAIN"),
    }
    return aggregate_by(dns, ["qname"], aggs)


def src_ip_breadth(dns: DataFrame) -> DataFrame:
    """Distinct names and requests per address."""
    return aggregate_by(dns, ["src_ip"], {"domains_queried": F.count_distinct("qname"), "total_requests": F.count("*")})


def daily_text_counts(df: DataFrame, columns: list[str], keys: list[str], day: str = "report_day") -> DataFrame:
    """Report counts carried as text, summed per report day; text that is no number counts as missing."""
    aggs = {c: F.sum(as_col(c).try_cast("bigint")) for c in columns}
    return aggregate_by(df, [as_col(day).try_cast("date").alias(day), *keys], aggs)


# ---- metrics in long form -------------------------------------------------------------------------------------


def metric_variant_coalesce(points: DataFrame, variants: list[str], keys: list[str], value: str = "amount") -> DataFrame:
    """One metric reported under several service keys: the value of the first key present, by the given order."""
    rank = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("service_key"))
    kept = points.filter(F.col("service_key").isin(*variants))
    per_variant = kept.groupBy(*keys, rank.alias("rank")).agg(F.sum(value).alias("total"))
    return per_variant.groupBy(*keys).agg(F.min_by("total", "rank").alias("total"))


# Names that read as gauges even when they carry a sum, and names that read as counters.
GAUGE_NAME = r"(?i)available|utilization|percent|latency|duration|depth|queue|capacity|free|used.?%|connectedclients|usedmemory"
COUNTER_NAME = r"(?i)(?:^|/|_)(?:count|request|error|fail|hit|evict|message|invocation|execution|run)s?(?:$|/|_)"
COUNTER_TAIL = r"(?i)hits?$|misses?$|evicted|operationsPerSecond|bytes_count|read_bytes|write_bytes|network.*(in|out)|throughput"


def is_counter(metric: Column, has_sum: Column) -> Column:
    """Counter by its name; a metric without a sum never is one."""
    return has_sum & ~metric.rlike(GAUGE_NAME) & (metric.rlike(COUNTER_NAME) | metric.rlike(COUNTER_TAIL))


def metric_sum_or_avg(points: DataFrame, keys: list[str], value: str = "amount", digits: int = 2) -> DataFrame:
    """Counters summed and gauges averaged, decided per metric name."""
    counter = is_counter(F.col("metric"), F.lit(True))
    total, mean = F.sum(value), F.avg(value)
    out = points.groupBy(*keys, "metric").agg(total.alias("__sum"), mean.alias("__avg"))
    shown = F.round(F.when(counter, F.col("__sum").cast("double")).otherwise(F.col("__avg")), digits)
    return out.select(*keys, "metric", F.when(counter, "sum").otherwise("avg").alias("stat"), shown.alias("shown"))


def principal_activity(df: DataFrame, user: str, actions: list[str], as_of: str, hours: int) -> DataFrame:
    """A user's listed actions in the look-back, newest first."""
    where = all_of([F.col("user_name") == user, F.col("action").isin(*actions)])
    kept = lookback(df, as_of, f"{hours} HOURS").filter(where)
    return kept.select("ts", "action", "src_ip", "bytes").orderBy(F.desc("ts"))
