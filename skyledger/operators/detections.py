"""Detection rules: query, threshold, cardinality, ordered and correlated signals.

A rule is data.  ``query_rule`` turns matching rows into alerts, ``threshold_rule`` counts them per window and key,
and ``run_rules`` evaluates a whole rule table in one scan and one shuffle.  All three accept streams, too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import any_of, as_col, ipv4_number
from skyledger.functions.ordered import running_until, with_previous
from skyledger.functions.timebucket import bucket, lookback, micros


# The tactic of each technique.
TACTICS = {
    "T1595": "Reconnaissance", "T1595.002": "Reconnaissance",
    "T1098.001": "Persistence",
    "T1078": "Privilege Escalation", "T1078.004": "Privilege Escalation",
    "T1562.001": "Defense Evasion", "T1562.008": "Defense Evasion",
    "T1528": "Credential Access",
    "T1087.004": "Discovery",
    "T1550.001": "Lateral Movement",
    "T1530": "Collection",
    "T1071.004": "Command and Control", "T1568": "Command and Control", "T1568.002": "Command and Control",
    "T1048": "Exfiltration", "T1048.003": "Exfiltration", "T1537": "Exfiltration",
    "T1496": "Impact",
}


@dataclass(frozen=True)
class Rule:
    """One detection rule; ``where`` is a SQL condition on log columns."""

    id: str
    name: str
    where: str
    severity: str = "medium"
    risk: int = 47
    technique: str | None = None
    keys: tuple[str, ...] = ()
    window: str = "15 minutes"
    min_count: int = 1
    distinct: str | None = None
    min_distinct: int = 0
    per_row: bool = False
    chain: str = field(default="other")
    streams: tuple[str, ...] = ()  # datasets the rule reads, "*" at the end for any ending; none: all
    further: tuple[str, ...] = ()  # techniques besides the first

    @property
    def techniques(self) -> tuple[str, ...]:
        return ((self.technique,) if self.technique else ()) + self.further

    @property
    def tactics(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(TACTICS[t] for t in self.techniques))

    @property
    def condition(self) -> str:
        """``where`` on rows of the rule's streams."""
        parts = [f"startswith(dataset, '{s[:-1]}')" if s.endswith("*") else f"dataset = '{s}'" for s in self.streams]
        return f"({' OR '.join(parts)}) AND ({self.where})" if parts else self.where


# Rule conditions, streams, thresholds, windows, severities, risk scores and techniques.
RULES: tuple[Rule, ...] = (
    Rule("D01", "Data run failure rate", "outcome = 'failure'", min_count=4, chain="data", streams=("aws.mwaa", "gcp.composer", "azure.datafactory")),
    Rule("D02", "Empty query result", "rows_returned = 0", chain="data", streams=("aws.athena", "gcp.bigquery", "azure.synapse")),
    Rule("D03", "Spark processing error", "error_type IS NOT NULL", chain="data", streams=("aws.emr", "gcp.dataproc", "azure.databricks")),
    Rule(
        "D04", "Source file format", "object_key NOT LIKE '%.avro' OR instr(object_key, '%') > 0",
        chain="data", streams=("aws.s3access", "gcp.gcs", "azure.blobstorage"),
    ),
    Rule("D05", "Slow run", "duration_ms > 60000", "low", 21, window="30 minutes", chain="data", streams=("aws.mwaa", "gcp.composer", "azure.datafactory")),
    Rule(
        "D06", "DNS query to suspicious domain",
        "(qname LIKE '%duckdns.org' OR qname LIKE '%ngrok.io' OR qname LIKE '%serveo.net' OR qname LIKE '%.xyz')",
        "high", 73, "T1071.004", ("host", "qname"), per_row=True, chain="dns", further=("T1048.003",),
    ),
    Rule("D07", "DNS firewall block", "rule_category = 'dns_firewall'", "high", 73, "T1568", ("host", "qname"), per_row=True, chain="dns"),
    Rule("D08", "High NXDOMAIN rate", "rcode = 'NXDOMAIN'", "high", 73, "T1568.002", ("host",), "1 hour", 5, chain="dns"),
    Rule("D09", "High unique domain count", "qname IS NOT NULL", "medium", 47, "T1595.002", ("host",), "1 hour", 15, "qname", 10, chain="dns", further=("T1048.003",)),
    Rule(
        "D12", "Access key created for another user", "action = 'CreateAccessKey' AND user_name <> target_user",
        "high", 73, "T1098.001", ("user_name", "src_ip"), per_row=True, chain="iam",
    ),
    Rule("D13", "Non-admin CreateAccessKey", "action = 'CreateAccessKey' AND user_name NOT LIKE '%admin%'", "high", 73, "T1098.001", chain="iam"),
    Rule(
        "D14", "Administrator policy attached", "action = 'AttachUserPolicy' AND message LIKE '%AdministratorAccess%' AND user_name NOT LIKE '%admin%'",
        "critical", 99, "T1078.004", ("user_name", "src_ip"), per_row=True, chain="iam",
    ),
    Rule("D15", "AssumeRole with a tactic", "action = 'AssumeRole' AND tactic IS NOT NULL", "critical", 95, "T1550.001", chain="iam"),
    Rule(
        "D16", "User enumeration", "action = 'ListUsers' AND user_name NOT LIKE '%admin%' AND user_name NOT LIKE '%service%'",
        "medium", 47, "T1087.004", ("user_name", "src_ip"), per_row=True, chain="iam",
    ),
    Rule(
        "D17", "IAM call without MFA",
        "action IN ('CreateAccessKey', 'AttachUserPolicy', 'AssumeRole') AND message LIKE '%mfa_authenticated%false%'",
        "high", 73, "T1528", ("user_name", "src_ip"), per_row=True, chain="iam",
    ),
    Rule(
        "D18", "Several IAM changes from one address", "action IN ('CreateAccessKey', 'AttachUserPolicy', 'AssumeRole')",
        "critical", 95, "T1078", ("src_ip",), "5 minutes", 3, "action", 2, chain="iam",
    ),
    Rule(
        "D19", "Dangerous IAM volume", "action IN ('CreateAccessKey', 'AttachUserPolicy', 'AssumeRole')",
        "high", 73, "T1078", ("user_name",), "30 minutes", 4, chain="iam",
    ),
    Rule("D20", "High or critical finding", "severity_num >= 7 OR severity IN ('High', 'Critical')", "high", 73, "T1496", ("src_ip",), per_row=True, chain="finding", streams=("aws.guardduty",)),
    Rule(
        "D21", "Multi-detector burst", "kind = 'alert'",
        "high", 73, min_count=3, chain="finding", streams=("aws.guardduty", "aws.securityhub_findings", "aws.securitylake"),
    ),
    Rule("D22", "Compliance failed", "rule_category = 'posture'", "medium", 47, "T1562.001", window="30 minutes", min_count=4, chain="finding", streams=("aws.securityhub*",)),
    Rule("D23", "Findings with a source address", "kind = 'alert' AND src_ip IS NOT NULL", "high", 73, window="30 minutes", min_count=6, chain="finding", streams=("aws.guardduty",)),
    Rule(
        "D24", "Crypto mining", "message LIKE '%CryptoCurrency%' OR message LIKE '%BitcoinTool%' OR message LIKE '%crypto%'",
        "high", 73, "T1496", ("src_ip",), per_row=True, chain="finding", streams=("aws.guardduty",),
    ),
    Rule("D25", "OCSF finding", "severity_num >= 7 OR level IN ('error', 'warn')", "high", 73, None, ("src_ip",), per_row=True, chain="finding", streams=("aws.securitylake",)),
    Rule("D26", "Root activity", "user_name = 'root' OR message LIKE '%Root%'", "critical", 99, "T1078.004", ("src_ip",), per_row=True, chain="finding", streams=("aws.cloudtrail",)),
    Rule(
        "D27", "Trail stopped", "action IN ('StopLogging', 'DeleteTrail', 'UpdateTrail', 'PutEventSelectors')",
        "critical", 99, "T1562.008", ("user_name", "src_ip"), per_row=True, chain="finding",
    ),
    Rule("D29", "Exfiltration finding", "finding_type LIKE 'Exfiltration%'", "critical", 99, "T1537", chain="exfil", streams=("aws.guardduty",)),
    Rule("D30", "High egress", "direction = 'egress' AND bytes > 52428800", "high", 73, "T1048", chain="exfil"),
    Rule("D31", "Bulk object reads", "action = 'GetObject' AND additional_count > 100", "high", 73, "T1530", chain="exfil"),
    Rule("D32", "GetObject burst", "action = 'GetObject'", "high", 73, "T1530", ("src_ip",), "5 minutes", 10, chain="exfil"),
    Rule("D33", "WAF block spike", "outcome = 'failure'", "medium", 47, "T1595", ("src_ip",), "15 minutes", 10, chain="exfil", streams=("aws.waf",)),
)

RULE_BY_ID = {r.id: r for r in RULES}


def _rule_columns(rule: Rule) -> dict[str, Column]:
    return {
        "rule_id": F.lit(rule.id),
        "rule_name": F.lit(rule.name),
        "severity": F.lit(rule.severity),
        "risk": F.lit(rule.risk),
        "technique": F.lit(rule.technique).cast("string"),
    }


def query_rule(df: DataFrame, rule: Rule, keep: list[str]) -> DataFrame:
    """An alert for every row that satisfies the rule."""
    return df.filter(F.expr(rule.condition)).select(*keep).withColumns(_rule_columns(rule))


def _seconds(interval: str) -> int:
    return _width_us(interval) // 1_000_000


def threshold_rule(
    df: DataFrame, rule: Rule, window: str | None = None, slide: str | None = None, approx: bool = False, ts: str = "ts"
) -> DataFrame:
    """An alert per window and key whose matching rows (and distinct values) reach the thresholds.

    ``slide`` re-checks a trailing window: rows are first aggregated to panes that no window cuts, and windows merge panes, so no row is
    copied per overlapping window.  ``approx`` counts distinct values by mergeable sketch, as streams require.
    """
    width = window or rule.window
    rows = df.filter(F.expr(rule.condition))
    if slide:
        grouped = _paned(rows, rule, width, slide, approx, ts)
    else:
        aggs = [F.count("*").alias("hits")]
        if rule.distinct:
            aggs.append((F.approx_count_distinct(rule.distinct) if approx else F.count_distinct(rule.distinct)).alias("distinct_values"))
        grouped = rows.groupBy(F.window(ts, width).alias("w"), *rule.keys).agg(*aggs)
    passed = F.col("hits") >= rule.min_count
    if rule.distinct:
        passed = passed & (F.col("distinct_values") >= rule.min_distinct)
    shown = [F.col("w.start").alias("window_start"), *rule.keys, "hits", *(["distinct_values"] if rule.distinct else [])]
    return grouped.filter(passed).select(*shown).withColumns(_rule_columns(rule))


def _paned(rows: DataFrame, rule: Rule, width: str, slide: str, approx: bool, ts: str) -> DataFrame:
    """Hits and distinct values per sliding window ``w`` and key, from one partial aggregate per pane.

    A pane is as long as the greatest common divisor of width and slide.  Exact distinct values keep one row per pane and value.
    """
    pane = F.window(ts, f"{math.gcd(_seconds(width), _seconds(slide))} seconds").alias("pane")
    sliding = F.window("pane", width, slide).alias("w")
    hits = F.sum("n").alias("hits")
    if not rule.distinct:
        return rows.groupBy(pane, *rule.keys).agg(F.count("*").alias("n")).groupBy(sliding, *rule.keys).agg(hits)
    if approx:
        panes = rows.groupBy(pane, *rule.keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(rule.distinct).cast("string")).alias("values"))
        merged = panes.groupBy(sliding, *rule.keys).agg(hits, F.hll_union_agg("values").alias("values"))
        return merged.withColumn("distinct_values", F.hll_sketch_estimate("values")).drop("values")
    panes = rows.groupBy(pane, *rule.keys, F.col(rule.distinct).alias("__value")).agg(F.count("*").alias("n"))
    return panes.groupBy(sliding, *rule.keys).agg(hits, F.count_distinct("__value").alias("distinct_values"))


def rule_table(spark, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rule metadata as a dimension; its size is the number of rules in code."""
    rows = [(r.id, r.name, r.severity, r.risk, r.technique, list(r.techniques), list(r.tactics), r.chain, r.min_count, r.min_distinct) for r in rules]
    return spark.createDataFrame(
        rows,
        "rule_id string, rule_name string, severity string, risk int, technique string, techniques array<string>, tactics array<string>, chain string, min_count int, min_distinct int",
    )


def _width_us(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def run_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, ts: str = "ts") -> DataFrame:
    """All rules in one scan: each row is tagged with the rules it satisfies, then counted per rule, entity and window."""
    us = micros(ts)
    tags = []
    for r in rules:
        entity = F.concat_ws("|", *[F.coalesce(as_col(k).cast("string"), F.lit("-")) for k in r.keys]) if r.keys else F.lit("*")
        width = _width_us(r.window)
        start = us - us % F.lit(width)
        tag = F.struct(
            F.lit(r.id).alias("rule_id"), entity.alias("entity"), start.alias("start"),
            (as_col(r.distinct).cast("string") if r.distinct else F.lit(None).cast("string")).alias("value"),
        )
        tags.append(F.when(F.expr(r.condition), tag))
    tagged = df.select(F.explode(F.array_compact(F.array(*tags))).alias("t")).select("t.*")
    grouped = tagged.groupBy("rule_id", "entity", "start").agg(
        F.count("*").alias("hits"), F.count_distinct("value").alias("distinct_values")
    )
    dimension = F.broadcast(rule_table(df.sparkSession, rules))
    passed = (F.col("hits") >= F.col("min_count")) & (F.col("distinct_values") >= F.col("min_distinct"))
    return (
        grouped.join(dimension, "rule_id")
        .filter(passed)
        .select("rule_id", "rule_name", "entity", F.timestamp_micros("start").alias("window_start"), "hits", "distinct_values", "severity", "risk", "technique")
    )


def attach_rule_metadata(hits: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Severity, risk, techniques and tactics for hits that carry only a rule id; the dimension holds one row per rule in code."""
    dimension = rule_table(hits.sparkSession, rules).drop("min_count", "min_distinct")
    return hits.join(F.broadcast(dimension), "rule_id", "left")


def tactic_coverage(hits: DataFrame, keys: list[str], row_id: str = "id") -> DataFrame:
    """Per key and tactic the hits and the different techniques; a rule with several tactics counts under each, without techniques nowhere."""
    of = F.create_map(*[F.lit(x) for pair in TACTICS.items() for x in pair])
    rows = hits.select(*keys, row_id, F.explode("techniques").alias("technique")).withColumn("tactic", F.try_element_at(of, F.col("technique")))
    return rows.groupBy(*keys, "tactic").agg(F.count_distinct("technique").alias("techniques"), F.count_distinct(row_id).alias("hits"))


# ---- DNS ------------------------------------------------------------------------------------------------------


def parent_domain(name: Column) -> Column:
    """The last two labels of a host name."""
    return F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)


def dns_tunnelling(dns: DataFrame, window: str = "1 hour", min_distinct: int = 6) -> DataFrame:
    """Hosts that ask for many distinct subdomains of one parent domain."""
    parent = parent_domain(F.col("qname"))
    rows = dns.withColumn("parent", parent).filter((F.col("parent") != "") & (F.col("qname") != F.col("parent")))
    grouped = rows.groupBy(F.window("ts", window).alias("w"), "host", "parent").agg(
        F.count_distinct("qname").alias("unique_subdomains"), F.count("*").alias("total")
    )
    return grouped.filter(F.col("unique_subdomains") >= min_distinct).select(
        F.col("w.start").alias("window_start"), "host", "parent", "unique_subdomains", "total"
    )


def resolved_before_block(dns: DataFrame) -> DataFrame:
    """Blocked names that the same host had resolved earlier; extremes per (host, name) replace a self-join."""
    blocked = F.col("rule_category") == "dns_firewall"
    grouped = dns.groupBy("host", "qname").agg(
        F.min(F.when(F.col("rcode") == "NOERROR", F.col("ts"))).alias("first_resolved"),
        F.max(F.when(blocked, F.col("ts"))).alias("last_blocked"),
        F.count_if(blocked).alias("blocks"),
    )
    return grouped.filter(F.col("first_resolved") < F.col("last_blocked"))


def beaconing(dns: DataFrame, min_gaps: int = 3, max_cv: float = 0.1, periods: tuple[int, ...] = (30, 60, 120), tolerance: float = 0.1) -> DataFrame:
    """Gap statistics per host and name, and whether the gaps are regular at one of the beacon periods (seconds)."""
    gaps = with_previous(dns, ["host", "qname"], "ts", ["ts"], ["id"])
    gap = (micros("ts") - micros("prev_ts")) / F.lit(1_000_000.0)
    stats = gaps.groupBy("host", "qname").agg(
        F.count(gap).alias("gaps"), F.avg(gap).alias("mean_gap"), F.stddev(gap).alias("sd_gap")
    )
    cv = F.try_divide(F.col("sd_gap"), F.col("mean_gap"))
    near = any_of([F.abs(F.col("mean_gap") - p) <= p * tolerance for p in periods])
    regular = (F.col("gaps") >= min_gaps) & (cv <= max_cv) & near
    return stats.filter(F.col("gaps") > 0).withColumn("beacon", F.coalesce(regular, F.lit(False)))


# Record types that can carry a payload.
PAYLOAD_TYPES = ("TXT", "CNAME")


def payload_lookups(dns: DataFrame, parents: list[str], as_of: str, interval: str = "24 HOURS", types: tuple[str, ...] = PAYLOAD_TYPES, keep: tuple[str, ...] = ("ts", "qname", "qtype", "answers")) -> DataFrame:
    """Look-ups below a command-and-control parent domain whose answers can carry a payload, newest first.

    ``parents`` is the investigator's list; a name counts if it is a parent or lies below one, in any case.
    """
    name = F.lower("qname")
    below = any_of([(name == p.lower()) | name.endswith("." + p.lower()) for p in parents])
    return lookback(dns, as_of, interval).filter(below & F.col("qtype").isin(*types)).select(*keep).orderBy(F.desc("ts"), "qname")


def name_entropy(label: Column) -> Column:
    """Shannon entropy (bits) of the characters of a name."""
    chars = F.split(label, "")
    size = F.size(chars).cast("double")
    share = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / size
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, ch: acc - share(ch) * F.log2(share(ch)))


def name_features(dns: DataFrame) -> DataFrame:
    """Length, digit share and entropy of the first label, once per distinct name."""
    names = dns.select("qname").filter(F.col("qname").isNotNull()).distinct()
    return names.withColumns(_features("qname"))


def _features(name: str) -> dict[str, Column]:
    label = F.substring_index(name, ".", 1)
    digits = F.try_divide(F.length(F.regexp_replace(label, "[^0-9]", "")), F.length(label))
    return {"label_length": F.length(label), "digit_share": digits, "entropy": name_entropy(label)}


def random_looking(min_length: int = 8, min_digit_share: float = 0.15, min_entropy: float = 2.5) -> Column:
    return (F.col("label_length") >= min_length) & (F.col("digit_share") >= min_digit_share) & (F.col("entropy") >= min_entropy)


def random_names(dns: DataFrame) -> DataFrame:
    """Look-ups of random-looking names, judged row by row: cheaper at scale than shuffling all rows to a name table."""
    return dns.withColumns(_features("qname")).filter(random_looking()).drop("label_length", "digit_share", "entropy")


def dga_hosts(dns: DataFrame, min_failed: int = 5) -> DataFrame:
    """Hosts with many failed look-ups of random-looking names and a later one that resolves."""
    rows = random_names(dns)
    failed = F.col("rcode") == "NXDOMAIN"
    grouped = rows.groupBy("host").agg(
        F.count_if(failed).alias("failed_random"),
        F.min(F.when(failed, F.col("ts"))).alias("first_failed"),
        F.max(F.when(F.col("rcode") == "NOERROR", F.col("ts"))).alias("last_resolved"),
    )
    return grouped.filter((F.col("failed_random") >= min_failed) & (F.col("last_resolved") > F.col("first_failed")))


# ---- networks, gaps, correlation ------------------------------------------------------------------------------


def outside_networks(ip: Column, cidrs: list[str]) -> Column:
    """True where the address lies in none of the listed IPv4 networks (a rule parameter, not data)."""
    number = ipv4_number(ip)
    inside = []
    for cidr in cidrs:
        base, bits = cidr.split("/")
        a, b, c, d = (int(x) for x in base.split("."))
        size = 1 << (32 - int(bits))
        low = (((a * 256 + b) * 256 + c) * 256 + d) // size * size
        inside.append(number.between(low, low + size - 1))
    return number.isNotNull() & ~any_of(inside)


def admin_role_from_outside(df: DataFrame, corporate: list[str], keep: list[str]) -> DataFrame:
    """AssumeRole on an admin role from an address outside the corporate networks."""
    where = (F.col("action") == "AssumeRole") & F.col("message").contains("AdminRole") & outside_networks(F.col("src_ip"), corporate)
    return df.filter(where).select(*keep)


def log_gaps(df: DataFrame, keys: list[str], width: str = "5 minutes", ts: str = "ts", as_of: str | None = None) -> DataFrame:
    """Stretches of empty buckets per stream: between two non-empty ones and, with ``as_of``, from the last one up to then.

    Only bucket rows are ordered, never events.  A stream that has gone silent has no next bucket; its gap ends with the last whole
    bucket before ``as_of``.
    """
    buckets = df.groupBy(*keys, bucket(ts, width).alias("bucket")).agg(F.count("*").alias("events"))
    step = _width_us(width)
    after = F.lead("bucket").over(Window.partitionBy(*keys).orderBy("bucket"))
    if as_of is not None:
        now = micros(F.lit(as_of).cast("timestamp"))
        after = F.coalesce(after, F.timestamp_micros(now - now % F.lit(step)))
    missing = ((micros("next") - micros("bucket")) / F.lit(step)).cast("long") - 1
    return (
        buckets.withColumn("next", after)
        .withColumn("missing_buckets", missing)
        .filter(F.col("missing_buckets") > 0)
        .select(*keys, F.timestamp_micros(micros("bucket") + F.lit(step)).alias("gap_start"), F.col("next").alias("gap_end"), "missing_buckets")
    )


def full_chain(df: DataFrame, signals: dict[str, str], window: str = "15 minutes", ts: str = "ts") -> DataFrame:
    """Windows in which every one of the named signals occurred."""
    tags = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in signals.items()]))
    rows = df.select(ts, F.explode(tags).alias("signal"))
    grouped = rows.groupBy(F.window(ts, window).alias("w")).agg(
        F.count_distinct("signal").alias("signals"), F.count("*").alias("rows")
    )
    return grouped.filter(F.col("signals") == len(signals)).select(F.col("w.start").alias("window_start"), "signals", "rows")


def suppress(alerts: DataFrame, mutes: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Alerts outside every mute interval [start_ts, end_ts) of their key.

    The latest end among intervals already begun decides, so no alert is paired with intervals.
    """
    seen = running_until(alerts, mutes, keys, F.col("end_ts"), "max", ts, "start_ts", "__muted_until")
    return seen.filter(F.col("__muted_until").isNull() | (F.col("__muted_until") <= F.col(ts))).drop("__muted_until")


def sum_threshold(df: DataFrame, keys: list[str], sums: dict[str, Column], window: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """Windows in which any of the summed measures is above zero, such as failed or dead-letter deliveries."""
    grouped = df.groupBy(F.window(ts, window).alias("w"), *keys).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    return grouped.filter(any_of([F.col(k) > 0 for k in sums])).select(F.col("w.start").alias("window_start"), *keys, *sums)
