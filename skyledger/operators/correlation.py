"""Joins that give alerts their context, and correlation of events into attack chains and data runs.

Look-ups keyed by time use the chunked helpers of ``functions.ordered``: a busy host or address costs a sort of bounded
chunks, never a product of its rows.  A missing match yields NULL columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import any_of
from skyledger.functions.joins import salted_left_join
from skyledger.functions.merged import PROBES, Latest, Newest, Trailing, fresh, merged_lookups
from skyledger.functions.ordered import asof_latest, in_overlapping_spans, interval_total, numbered, previous_rows, trailing_count
from skyledger.functions.timebucket import micros
from skyledger.operators.dashboards import PRIVESC_ACTIONS
from skyledger.session import cut_lineage

HOUR, WEEK = 3600, 7 * 86400

# Asset categories that may be named in an alert, states of a finished incident, data-run datasets.
CI_CATEGORIES = ("Compute", "Security", "Cloud Service", "Identity")
DONE_STATES = ("Resolved", "Closed")
RUN_DATASETS = ("aws.mwaa", "gcp.composer", "azure.data_factory", "aws.emr_logs", "gcp.dataproc")

# ---- alert context --------------------------------------------------------------------------------------------


def attack_source(alerts: DataFrame, events: DataFrame, key: str = "host", seconds: int = HOUR) -> DataFrame:
    """The latest audit event of the alert's entity in the hour before it, among escalation calls and session rows."""
    relevant = events.filter(audit_rows())
    return asof_latest(alerts, relevant, [key], ["src_ip", "user_name", "action"], "id", seconds, prefix="attack_")


def newest_per_key(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows per key; Spark cuts each partition to ``n`` per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def affected_ci(alerts: DataFrame, ci: DataFrame, key: str = "host", n: int = 3, keep: tuple[str, ...] = ("ci_id", "name", "owner", "department")) -> DataFrame:
    """The newest items of the allowed categories on the alert's host, up to ``n`` rows per alert."""
    allowed = ci.filter(F.col("category").isin(*CI_CATEGORIES) & F.col(key).isNotNull())
    newest = newest_per_key(allowed, key, ["ts", "ci_id"], n).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", *[F.col(c).alias(f"ci_{c}" if c != "ci_id" else c) for c in keep]))).alias("__ci")
    )
    joined = salted_left_join(alerts, newest, [key], "id")
    return joined.select(*alerts.columns, F.explode_outer("__ci").alias("__c")).select(*alerts.columns, "__c.*")


def target_user(alerts: DataFrame, staff: DataFrame) -> DataFrame:
    """Profile of the user an alert names: the newest record of that user name."""
    latest = staff.groupBy("user_name").agg(F.max_by(F.struct("full_name", "email", "manager"), F.struct("ts", "email")).alias("__u"))
    joined = salted_left_join(alerts, latest, ["user_name"], "id")
    return joined.select(*alerts.columns, "__u.full_name", "__u.email", "__u.manager")


def open_incidents(alerts: DataFrame, tickets: DataFrame, key: str = "host") -> DataFrame:
    """Incidents of the last seven days on the alert's host that are neither resolved nor closed."""
    unfinished = tickets.filter((F.col("kind") == "incident") & ~F.col("state").isin(*DONE_STATES))
    return trailing_count(alerts, unfinished, [key], WEEK, "open_incident_count")


def recent_changes(alerts: DataFrame, tickets: DataFrame, key: str = "host") -> DataFrame:
    """Change requests of the last seven days on the alert's host: how many, and the latest."""
    changes = tickets.filter(F.col("kind") == "change_request").withColumnRenamed("id", "change_id")
    slim = alerts.select("id", "ts", key)
    latest = asof_latest(slim, changes, [key], ["change_id", "priority"], "change_id", WEEK, prefix="latest_").drop("ts", key)
    return attach(alerts, trailing_count(slim, changes, [key], WEEK, "change_count").select("id", "change_count"), latest)


def related_alert_count(alerts: DataFrame, tag: str = "Attack Discovery", key: str | None = None) -> DataFrame:
    """Tagged alerts in the hour up to each alert, over all entities unless a key is given.

    A task counts the alerts of one second at most, so neither all entities at once nor a busy minute is too much for it.
    """
    return attach(alerts, merged_lookups(alerts, [Trailing("related_alert_count", PROBES, key, HOUR, F.col("tag") == tag)], {}))


def related_alerts(alerts: DataFrame, key: str = "src_ip", n: int = 10) -> DataFrame:
    """Up to ``n`` earlier alerts of the last seven days on the same address, newest first."""
    with_list = previous_rows(alerts, [key], "ts", "id", ["rule", "severity"], n, WEEK, "__related")
    pos = with_list.select("id", key, F.posexplode("__related").alias("pos", "r"))
    return pos.select(
        "id", key, (F.col("pos") + 1).alias("rank"), F.col("r.id").alias("related_id"), F.col("r.rule").alias("related_rule"),
        F.col("r.severity").alias("related_severity"), F.col("r.ts").alias("related_ts"),
    )


def attach(base: DataFrame, *parts: DataFrame, on: str = "id") -> DataFrame:
    """Left-join look-up results, each computed from the base rows on its own, back to the base."""
    out = base
    for part in parts:
        out = out.join(part, on, "left")
    return out


def audit_rows() -> Column:
    """Audit events that may explain an alert: escalation calls and session rows with an address and a user."""
    return F.col("src_ip").isNotNull() & F.col("user_name").isNotNull() & (F.col("action").isin(*PRIVESC_ACTIONS) | F.col("session").isNotNull())


def enrich_alert(alerts: DataFrame, events: DataFrame, ci: DataFrame, staff: DataFrame, tickets: DataFrame) -> DataFrame:
    """One wide row per alert: attack source, newest asset, user profile, open incidents, changes and related alerts.

    All look-ups are one merge: each table is read once, and its rows meet the alerts in one shuffle by entity and second.
    """
    change = F.col("kind") == "change_request"
    lookups = [
        Latest("attack", "events", "host", ("src_ip", "user_name", "action"), "id", HOUR, audit_rows()),
        Newest("asset", "ci", "host", ("ci_id", "name", "owner", "department"), ("ts", "ci_id"), F.col("category").isin(*CI_CATEGORIES)),
        Newest("profile", "staff", "user_name", ("full_name", "email", "manager"), ("ts", "email")),
        Trailing("open_incident_count", "tickets", "host", WEEK, (F.col("kind") == "incident") & ~F.col("state").isin(*DONE_STATES)),
        Trailing("change_count", "tickets", "host", WEEK, change),
        Latest("change", "tickets", "host", ("id", "priority"), "id", WEEK, change),
        Trailing("related_alert_count", PROBES, None, HOUR, F.col("tag") == "Attack Discovery"),
    ]
    found = merged_lookups(alerts, lookups, {"events": events, "ci": ci, "staff": staff, "tickets": tickets})
    out = attach(alerts, found).withColumns({"attack": fresh("attack", "ts", HOUR), "change": fresh("change", "ts", WEEK)})
    return out.select(
        *alerts.columns,
        F.timestamp_micros("attack.__at").alias("attack_ts"), *[F.col(f"attack.{c}").alias(f"attack_{c}") for c in ("src_ip", "user_name", "action")],
        F.col("asset.ci_id").alias("ci_id"), *[F.col(f"asset.{c}").alias(f"ci_{c}") for c in ("name", "owner", "department")],
        "profile.full_name", "profile.email", "profile.manager", "open_incident_count", "change_count",
        F.timestamp_micros("change.__at").alias("latest_ts"), F.col("change.id").alias("latest_change_id"), F.col("change.priority").alias("latest_priority"),
        "related_alert_count",
    )


def run_alert_enrich(alerts: DataFrame, events: DataFrame, ci: DataFrame, staff: DataFrame, datasets: tuple[str, ...] = RUN_DATASETS) -> DataFrame:
    """Context of data-run alerts: the latest operator of the workflow, that user's profile and the workflow's asset."""
    runs = events.filter(F.col("user_name").isNotNull() & F.col("dataset").isin(*datasets))
    named = alerts.drop("user_name")
    out = asof_latest(named, runs, ["dag_id"], ["user_name"], "id", HOUR, prefix="run_").withColumnRenamed("run_user_name", "user_name")
    out = target_user(out, staff)
    return affected_ci(out, ci.withColumnRenamed("resource", "dag_id").drop("host"), key="dag_id", n=1).drop("rank")


def ci_by_any_name(alerts: DataFrame, ci: DataFrame, rule_col: str, bus_col: str, text: str) -> DataFrame:
    """The newest item whose name is the rule, whose resource is the bus, or whose description has the text.

    The OR is a union of equi-joins on one row per name and per resource; the text match is one row for all alerts.
    """
    best = F.max(F.struct("ts", "ci_id")).alias("__hit")
    by_name = ci.groupBy(F.col("name").alias(rule_col)).agg(best)
    by_bus = ci.groupBy(F.col("resource").alias(bus_col)).agg(best)
    by_text = ci.filter(F.lower("short_description").contains(text.lower())).agg(best)
    out = salted_left_join(alerts, by_name.withColumnRenamed("__hit", "__n"), [rule_col], "id")
    out = salted_left_join(out, by_bus.withColumnRenamed("__hit", "__b"), [bus_col], "id")
    hit = F.array_max(F.array_compact(F.array("__n", "__b", by_text.scalar())))
    return out.select(*alerts.columns, hit.getField("ci_id").alias("ci_id"), hit.getField("ts").alias("ci_ts"))


def ci_impact(edges: DataFrame, roots: DataFrame, depth: int = 3, downstream: bool = True) -> DataFrame:
    """Items reached from each root within ``depth`` relations, at their smallest distance; cycles end.

    ``edges`` (parent, child), ``roots`` (root).  Roots are numbered and 64 of them share a word of bits, so one pass over the edges moves
    all roots a step on: an item's words are or-ed, and bits that it had before are dropped.  The distinct edges and the words of each step
    are cut loose from their lineage, so no step derives them again.
    """
    src, dst = ("parent", "child") if downstream else ("child", "parent")
    links = cut_lineage(edges.select(F.col(src).alias("__from"), F.col(dst).alias("__to")).distinct())
    numbered = cut_lineage(roots.select("root").distinct().withColumn("__n", F.monotonically_increasing_id()))
    word, bit = F.shiftright("__n", 6), F.expr("shiftleft(1L, int(__n & 63))")
    fresh = cut_lineage(numbered.select(F.col("root").alias("item"), word.alias("word"), bit.alias("bits")))
    seen, steps = fresh, []
    for step in range(1, depth + 1):
        moved = fresh.join(links, F.col("item") == F.col("__from")).groupBy(F.col("__to").alias("item"), "word").agg(F.bit_or("bits").alias("bits"))
        had = seen.groupBy("item", "word").agg(F.bit_or("bits").alias("had"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        fresh = cut_lineage(moved.join(had, ["item", "word"], "left").select("item", "word", new.alias("bits")).filter("bits <> 0"))
        seen = seen.unionByName(fresh)
        steps.append(fresh.withColumn("distance", F.lit(step)))
    reached = reduce(DataFrame.unionByName, steps)
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    found = reached.select("word", F.explode(set_bits).alias("bit"), "item", "distance").withColumn("__n", F.shiftleft("word", 6) + F.col("bit"))
    return found.join(numbered, "__n").select("root", "item", "distance")


# ---- attack chains --------------------------------------------------------------------------------------------


def chain_by_label(df: DataFrame, label: str = "session") -> DataFrame:
    """All rows of each attack session with their step number; rows stay rows, however long a session is."""
    return numbered(df.filter(F.col(label).isNotNull()), [label], "ts", ["id"], "step")


def ordered_sequence(df: DataFrame, actor: str, actions: tuple[str, ...], within_seconds: int) -> DataFrame:
    """Starts of complete ordered sequences: each action strictly later than the one before, all within the time limit.

    For every first action the earliest continuation is followed.  Rows are grouped by actor and overlapping time spans,
    so a group never holds more than two spans of one actor.
    """
    rows = in_overlapping_spans(df.filter(F.col("action").isin(*actions)).select(actor, "ts", "action", micros("ts").alias("us")), "ts", within_seconds)
    later = Window.partitionBy(actor, "__span").orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, -1)
    names = [f"t{i + 1}" for i in range(len(actions))]
    nxt: Column | None = None
    for i in range(len(actions) - 1, 0, -1):
        here = [F.col("us").alias(names[i])]
        if nxt is not None:
            here += [F.col("__next").getField(n).alias(n) for n in names[i + 1 :]]
        nxt = F.min(F.when(F.col("action") == actions[i], F.struct(*here))).over(later)
        rows = rows.withColumn("__next", nxt)
    starts = rows.filter((F.col("action") == actions[0]) & (F.col("__span") == F.col("__own")))
    end = F.col("__next").getField(names[-1])
    done = starts.filter(end.isNotNull() & (end - F.col("us") <= within_seconds * 1_000_000))
    times = [F.timestamp_micros(F.col("__next").getField(n)).alias(n) for n in names[1:]]
    return done.select(actor, F.col("ts").alias("t1"), *times)


def privesc_sequence(df: DataFrame, within_seconds: int = HOUR) -> DataFrame:
    """Enumerate, create key, attach policy, assume role: in order, per user, without a session label."""
    return ordered_sequence(df, "user_name", PRIVESC_ACTIONS, within_seconds)


def exfil_join(df: DataFrame, key: str = "src_ip", window_seconds: int = 900, min_bytes: int = 52428800) -> DataFrame:
    """Exfiltration findings with object reads and large egress by the same address around the same time."""
    findings = df.filter(F.col("finding_type").startswith("Exfiltration")).select("id", "ts", key, "finding_type")
    reads = df.filter(F.col("action") == "GetObject")
    egress = df.filter((F.col("direction") == "egress") & (F.col("bytes") > min_bytes))
    slim = findings.select("id", "ts", key)
    near_reads = interval_total(slim, reads, [key], window_seconds, "object_reads", after=window_seconds)
    near_egress = interval_total(slim, egress, [key], window_seconds, "egress_bytes", after=window_seconds, value=F.col("bytes"))
    out = attach(findings, near_reads.select("id", "object_reads"), near_egress.select("id", "egress_bytes"))
    return out.filter((F.col("object_reads") > 0) & (F.col("egress_bytes") > 0))


def finding_lineage(detector: DataFrame, hub: DataFrame, lake: DataFrame) -> DataFrame:
    """Detector to hub to lake by native ids, with the lag of each hop in seconds."""
    seconds = lambda a, b: (micros(b) - micros(a)) / F.lit(1_000_000)
    h = hub.select(F.col("id").alias("hub_id"), F.col("ts").alias("hub_ts"), F.explode("related").alias("__d"))
    lk = lake.select(F.col("id").alias("lake_id"), F.col("ts").alias("lake_ts"), F.explode("related").alias("__h"))
    d = detector.select(F.col("id").alias("detector_id"), F.col("ts").alias("detector_ts"))
    out = d.join(h, F.col("detector_id") == F.col("__d")).join(lk, F.col("hub_id") == F.col("__h"), "left")
    return out.select(
        "detector_id", "hub_id", "lake_id", seconds("detector_ts", "hub_ts").alias("hub_lag"), seconds("hub_ts", "lake_ts").alias("lake_lag")
    )


def dns_c2_stages(dns: DataFrame, suspicious: Column, keys: list[str]) -> DataFrame:
    """Per key the probe, resolve, beacon and block stages of a command-and-control chain, and whether they came in order."""
    blocked = F.coalesce(F.col("rule_category") == "dns_firewall", F.lit(False))
    probe = (F.col("rcode") == "NXDOMAIN") & ~blocked
    resolved = (F.col("rcode") == "NOERROR") & suspicious
    at = lambda fn, cond: fn(F.when(cond, F.col("ts")))
    out = dns.groupBy(*keys).agg(
        at(F.min, probe).alias("first_probe"), at(F.min, resolved).alias("first_resolved"), at(F.max, resolved).alias("last_beacon"),
        at(F.max, blocked).alias("last_block"), F.count_if(resolved).alias("resolutions"),
    )
    in_order = (F.col("first_probe") < F.col("first_resolved")) & (F.col("first_resolved") < F.col("last_beacon")) & (F.col("last_beacon") < F.col("last_block"))
    return out.withColumn("complete", F.coalesce(in_order, F.lit(False)))


def multi_chain_story(alerts: DataFrame, key: str = "host", min_chains: int = 2) -> DataFrame:
    """Entities with alerts of several chains; tactics in order of first sight.  Lists hold one entry per chain or tactic."""
    per_tactic = alerts.groupBy(key, "chain", "tactic").agg(F.min("ts").alias("first"), F.count("*").alias("n"))
    out = per_tactic.groupBy(key).agg(
        F.count_distinct("chain").alias("chains"), F.sum("n").alias("alerts"),
        F.array_sort(F.collect_list(F.struct("first", "tactic"))).alias("__t"), F.min("first").alias("first_alert"),
    )
    story = F.array_join(F.transform("__t", lambda x: x.getField("tactic")), " > ")
    return out.filter(F.col("chains") >= min_chains).select(key, "chains", "alerts", "first_alert", story.alias("story"))


def mttd_lag(df: DataFrame, blocked: Column, label: str = "session") -> DataFrame:
    """Seconds from the first signal of a chain to its first block after that."""
    out = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min("ts").alias("first_signal"), F.min(F.when(blocked, F.col("ts"))).alias("first_block"))
    lag = (micros("first_block") - micros("first_signal")) / F.lit(1_000_000)
    return out.filter(F.col("first_block").isNotNull()).withColumn("lag_seconds", lag)


# ---- data runs ------------------------------------------------------------------------------------------------


def run_rollup(stages: DataFrame) -> DataFrame:
    """Stages, status, time span and busy time per run."""
    return stages.groupBy("run_id").agg(
        F.count("*").alias("stages"),
        F.when(F.count_if(F.col("outcome") == "failure") > 0, "failure").otherwise("success").alias("status"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.sum("duration_ms").alias("busy_ms"),
    )


def silent_empty_runs(stages: DataFrame) -> DataFrame:
    """Runs whose compute and query stages succeeded on no rows; one aggregate per run instead of a stage join."""
    empty = lambda stage: F.count_if((F.col("stage") == stage) & (F.col("outcome") == "success") & (F.col("rows_read") == 0))
    out = stages.groupBy("run_id").agg(empty("spark").alias("empty_spark"), empty("query").alias("empty_query"))
    return out.filter((F.col("empty_spark") > 0) & (F.col("empty_query") > 0)).select("run_id")


def schema_drift_impact(stages: DataFrame) -> DataFrame:
    """Runs with a schema drift at the crawler and a later failed query."""
    out = stages.groupBy("run_id").agg(
        F.min(F.when((F.col("stage") == "crawler") & F.col("schema_drift"), F.col("ts"))).alias("drift_ts"),
        F.max(F.when((F.col("stage") == "query") & (F.col("outcome") == "failure"), F.col("ts"))).alias("failed_ts"),
    )
    return out.filter(F.col("drift_ts") < F.col("failed_ts"))


def suspicious_name(name: str = "qname") -> Column:
    """Names under the watched dynamic-DNS and tunnelling providers."""
    return any_of([F.col(name).endswith(x) for x in ("duckdns.org", "ngrok.io", "serveo.net", ".xyz")])
