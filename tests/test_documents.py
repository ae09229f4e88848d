"""Traces, knowledge base, quality checks, sources and sinks on literal rows."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from skyledger.functions.columns import nest, wildcard
from skyledger.functions.timebucket import auto_interval
from skyledger.operators import knowledge as kb
from skyledger.operators import quality as q
from skyledger.operators import traces as t
from skyledger.sources import sinks
from skyledger.sources.routing import route_target
from skyledger.sources.streams import read_stream, read_streams, split_pattern

T0 = dt.datetime(2024, 1, 1)
SPAN = (
    "ts timestamp, trace_id string, span_id string, tx_id string, parent_id string, kind string, type string, subtype string, action string, "
    "name string, duration_us long, outcome string, result string, service string, environment string, labels map<string,string>"
)


def test_span_conversion(spark):
    ts = dt.datetime(2024, 1, 1, 0, 0, 0, 123000)
    rows = [
        (ts, "t1", "s1", "x1", "x1", "span", "db", "dynamodb", "query", "Query", 1500, "failure", None, "svc", "prod", {"error.message": "boom", "db.system": "kept"}),
        (ts, "t1", None, "x1", None, "transaction", "messaging", None, None, "tx", None, "success", "503", "svc", "prod", None),
        (ts, "t1", None, "x2", "", "transaction", "request", None, None, None, 10, None, "success", "svc", None, {"empty": ""}),
    ]
    out = [r.asDict(recursive=True) for r in t.apm_to_otlp_span(spark.createDataFrame(rows, SPAN)).collect()]
    db, msg, req = out
    assert db["startTimeUnixNano"] == "1704067200123000000" and db["endTimeUnixNano"] == "1704067200124500000"
    assert (db["kind"], msg["kind"], req["kind"]) == (1, 5, 2)
    assert db["status"] == {"code": 2, "message": "boom"} and msg["status"]["code"] == 1 and req["status"]["code"] == 0
    attrs = {a["key"]: a["value"]["stringValue"] or a["value"]["intValue"] for a in db["attributes"]}
    assert attrs == {"error.message": "boom", "db.system": "kept", "db.operation": "query"}
    assert [(a["key"], a["value"]["intValue"]) for a in msg["attributes"]] == [("http.response.status_code", "503")]
    assert req["attributes"] == [] and req["parentSpanId"] is None and req["name"] == "span" and msg["endTimeUnixNano"] == msg["startTimeUnixNano"]


def test_batches_are_bounded_and_whole(spark):
    rows = [(T0, f"t{i}", f"s{i}", None, None, "span", "app", None, None, "n", 1, None, None, "hot", "prod", None) for i in range(1000)]
    batches = t.group_resource_spans(spark.createDataFrame(rows, SPAN), max_spans=100)
    sizes = [r[0] for r in batches.select(F.size(F.col("resourceSpans.scopeSpans")[0]["spans"])).collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) < 200
    text = json.loads(t.otlp_requests(batches).first()["value"])
    resource = text["resourceSpans"][0]["resource"]["attributes"]
    assert {"key": "service.name", "value": {"stringValue": "hot"}} in resource


def test_documents_are_moved_once_before_they_become_spans(spark, monkeypatch):
    rows = [(T0, f"t{i % 90}", f"s{i}", None, None, "span", "app", None, None, "n", i, None, None, f"svc{i % 3}" if i % 7 else None, "prod" if i % 2 else None, None) for i in range(600)]
    rows += [rows[5], (None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, SPAN)
    monkeypatch.setattr(t, "TASK_SPANS", 100, raising=False)
    batches = t.group_resource_spans(frame, max_spans=20)
    plan = batches._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    read = lambda df: sorted((r["service"], r["environment"], r["batch"], r["resourceSpans"]["resource"]["attributes"], sorted(map(str, r["resourceSpans"]["scopeSpans"][0]["spans"]))) for r in df.collect())
    got = read(batches)
    assert sum(len(r[4]) for r in got) == 602 and len({r[:3] for r in got}) == len(got)
    monkeypatch.setattr(t, "checked_broadcast", lambda dim: dim)  # as if there were too many resources
    assert read(t.group_resource_spans(frame, max_spans=20)) == got


def test_span_kinds(spark):
    df = spark.createDataFrame([("messaging", None, "ReceiveMessage"), ("app", "sqs", "send"), ("app", None, None), ("db", None, None), ("app", "redis", None)], "a string, b string, c string")
    assert [r[0] for r in df.select(t.span_kind_name(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["CONSUMER", "PRODUCER", "INTERNAL", "CLIENT", "CLIENT"]


def test_integrity_of_odd_traces(spark):
    row = lambda tr, s, p: (T0, tr, s, None, p, "span", "app", None, None, "n", 1, None, None, "s", None, None)
    rows = [row("ok", "a", None), row("ok", "b", "a"), row("orphan", "a", None), row("orphan", "b", "zz"), row("two", "a", None), row("two", "b", None), row("one", "a", None)]
    got = {r["trace_id"]: r["valid"] for r in t.trace_integrity(spark.createDataFrame(rows, SPAN)).collect()}
    assert got == {"ok": True, "orphan": False, "two": False, "one": False}


def test_bad_time_reads_zero(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00.5Z",), ("nonsense",), (None,)], "x string")
    assert [r[0] for r in df.select(t.iso_to_unix_nano(F.col("x"))).collect()] == ["1704067200500000000", "0", "0"]


LONG = "x" * 51


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"# T\n\nintro\n## A\n{LONG}\n## B\n{'y' * 50}\n", [("A", "T", LONG)]),
        (f"# T\n{LONG}\n", [("T", None, f"# T\n{LONG}")]),
        (f"no titles {LONG}", [("guide", None, f"no titles {LONG}")]),
        ("short", []),
        (f"## A\n{LONG}\n# Late\n{LONG}", [("A", "Late", f"{LONG}\n\n{LONG}".replace("\n\n", "\n"))]),
        (f"# T\n## A  \n\n{LONG}\n### sub\nmore\n", [("A", "T", f"{LONG}\n### sub\nmore")]),
    ],
)
def test_chunks(spark, text, want):
    df = spark.createDataFrame([("docs/guide.md", "c", text)], "source string, category string, content string")
    got = [(r["title"], r["parent_title"], r["content"].replace("\n\n", "\n")) for r in kb.chunk_markdown(df).orderBy("chunk").collect()]
    assert got == want


def test_all_nine_tags_severity_and_ids(spark):
    text = "Containment ES|QL escalate MITRE TA0001 T1098.001 T1098.001 IAM GuardDuty exfil CloudTrail CMDB high"
    df = spark.createDataFrame([(text,), ("plain highway",)], "content string")
    rows = kb.extract_mitre(kb.chunk_severity(kb.tag_chunks(df, ["aws"]))).collect()
    assert len(rows[0]["tags"]) == 10 and rows[0]["severity"] == "high"
    # A tactic id contains what reads as a technique id, as the patterns are stated.
    assert rows[0]["mitre_tactic"] == ["TA0001"] and rows[0]["mitre_technique"] == ["T1098.001"]
    assert rows[1]["tags"] == ["aws"] and rows[1]["severity"] is None


def test_search_ranks_and_misses(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha alpha"), (3, "gamma"), (4, "")], "id int, content string")
    assert [r["id"] for r in kb.keyword_search(df, "Alpha", 5).collect()] == [2, 1]
    assert kb.keyword_search(df, "delta", 5).count() == 0
    with pytest.raises(ValueError):
        kb.keyword_search(df, "--", 5)


def test_vector_search_skips_zero_and_wrong_size(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0])], "vec_id int, embedding array<float>")
    assert [r["vec_id"] for r in kb.vector_search(df, [1.0, 0.0], 5).collect()] == [1, 4]


def test_log_contract_on_broken_documents(spark):
    df = spark.createDataFrame([("aws", None), ("aws", "no json"), ("aws", '{"@timestamp":"t","event":{"category":["x"],"outcome":"success"}}')], "vendor string, doc string")
    assert [r["violations"] for r in q.log_contract(df).collect()] == [["timestamp"], ["timestamp"], []]


def test_addresses(spark):
    df = spark.createDataFrame([("0.0.0.1",), ("255.1.1.1",), ("172.20.0.1",), ("8.8.8.8",), ("x",), (None,)], "a string")
    assert [len(r["violations"]) for r in q.ip_contract(df, ["a"]).collect()] == [1, 1, 0, 0, 1, 0]


def test_coverage_by_any_alias(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "dataset string")
    out = q.dataset_coverage(one("azure.entra_id", "azure.policy", "aws.waf"), one("azure.provisioning", "aws.waf"), q.alias_table(spark))
    assert {r["dataset"]: r["covered"] for r in out.collect()} == {"azure.entra_id": True, "azure.policy": False, "aws.waf": True}


def test_routes(spark):
    rows = [
        ("aws", "logs-aws", "aws.glue", None, "logs-aws.glue-default"), ("aws", "logs-aws", "aws.xray", None, "traces-aws.xray-default"),
        ("aws", "logs-aws", "custom", None, "logs-custom-default"), ("gcp", "logs-gcp", "gcp.audit", None, "logs-gcp.audit-default"),
        ("aws", "logs-aws", "aws.glue", "apm", "traces-apm-default"), ("gcp", "logs-gcp", "gcp.a", "metrics-aws.emr", "metrics-aws.emr-default"),
        ("aws", "metrics-aws", "aws.glue", "aws.emr", "metrics-aws.emr-default"), ("gcp", "logs-gcp", "gcp.a", "gcp.b", "logs-gcp.b-default"),
    ]
    df = spark.createDataFrame(rows, "v string, p string, d string, t string, want string")
    for r in df.select("want", route_target(F.col("v"), F.col("p"), F.col("d"), F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_patterns_and_ladder(spark):
    assert split_pattern("logs-aws.vpc*-default") == ("logs", "aws.vpc*", "default")
    assert split_pattern("traces-apm*") == ("traces", "apm*", "*")
    with pytest.raises(ValueError):
        split_pattern("alerts-x")
    assert auto_interval(T0, T0 + dt.timedelta(seconds=75)) == 1
    assert auto_interval(T0, T0 + dt.timedelta(seconds=76)) == 5
    assert auto_interval(T0, T0 + dt.timedelta(days=10000)) == 2592000
    df = spark.createDataFrame([("a_b",), ("axb",), ("a.b",)], "x string")
    assert df.filter(wildcard("x", "a_b")).count() == 1 and df.filter(wildcard("x", "a?b")).count() == 3 and df.filter(wildcard("x", "a*")).count() == 3


def test_nest(spark):
    df = spark.createDataFrame([(1, "x", 2)], "`a.b` int, c string, `a.d.e` int")
    assert nest(df).first().asDict(recursive=True) == {"a": {"b": 1, "d": {"e": 2}}, "c": "x"}


def test_streams_round_trip_and_prune(spark, tmp_path):
    df = spark.createDataFrame([(1, T0, "logs-aws.glue-default"), (2, T0, "logs-gcp.audit-default"), (3, T0 + dt.timedelta(days=1), "metrics-aws.emr-default")], "id int, ts timestamp, target string")
    sinks.write_by_stream(df, str(tmp_path))
    one = read_stream(spark, str(tmp_path), "logs-aws.*")
    assert [r["id"] for r in one.collect()] == [1]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    both = read_streams(spark, str(tmp_path), "logs-gcp.*", "metrics-*")
    assert sorted(r["id"] for r in both.collect()) == [2, 3]


def test_append_only_new(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert sinks.append_new(batch(1, 2, 2), path, "id", None) == {"created": 2, "skipped": 1}
    assert sinks.append_new(batch(2, 3), path, "id", spark.read.parquet(path)) == {"created": 1, "skipped": 1}
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert sinks.append_new(batch(1, 3), path, "id", spark.read.parquet(path)) == {"created": 0, "skipped": 2}
    assert sinks.append_new(batch(1).limit(0), path, "id", spark.read.parquet(path)) == {"created": 0, "skipped": 0}
    assert sinks.append_new(batch(None, None, 4), path, "id", spark.read.parquet(path)) == {"created": 3, "skipped": 0}
    assert sinks.append_new(batch(None), path, "id", spark.read.parquet(path)) == {"created": 1, "skipped": 0}


def test_filtered_appends_read_only_groups_that_may_repeat(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id int, v string")
    assert sinks.append_filtered(batch([*range(1000), 5, 5]), path, "id") == {"created": 1000, "skipped": 2, "groups_read": 0}
    assert sinks.append_filtered(batch(range(1000, 3000)), path, "id") == {"created": 2000, "skipped": 0, "groups_read": 0}
    assert sinks.append_filtered(batch(range(2990, 3010)), path, "id") == {"created": 10, "skipped": 10, "groups_read": 1}
    assert sinks.append_filtered(batch([0, 1500, 3005]), path, "id") == {"created": 0, "skipped": 3, "groups_read": 3}
    assert sinks.append_filtered(batch([None, None, 3005, 9999]), path, "id") == {"created": 3, "skipped": 1, "groups_read": 1}
    assert sinks.append_filtered(batch([]), path, "id") == {"created": 0, "skipped": 0, "groups_read": 0}
    rows = spark.read.parquet(f"{path}/rows").collect()
    assert len(rows) == 3013 and sorted(r["id"] for r in rows if r["id"] is not None) == [*range(3010), 9999]


def test_appends_whose_filter_is_missing_are_read(spark, tmp_path):
    """A failure between the rows and their filter never lets a known key pass."""
    import shutil

    path = str(tmp_path / "t")
    batch = lambda ids: spark.createDataFrame([(i,) for i in ids], "id int")
    sinks.append_filtered(batch(range(50)), path, "id")
    sinks.append_filtered(batch(range(50, 80)), path, "id")
    (first,) = [g for g in (tmp_path / "t" / "sizes").iterdir() if g.name.startswith("group=") and spark.read.parquet(f"{path}/rows/{g.name}").count() == 50]
    shutil.rmtree(first)
    assert sinks.append_filtered(batch([7, 60, 90]), path, "id") == {"created": 1, "skipped": 2, "groups_read": 2}


def test_units_stay_below_the_cap(spark, tmp_path):
    import glob
    import os

    df = spark.range(5000).select("id", F.repeat(F.lit("x"), 100).alias("text"))
    sinks.size_capped_write(df, str(tmp_path / "u"), "id", max_bytes=20_000)
    files = glob.glob(str(tmp_path / "u" / "*" / "*.txt"))
    assert max(os.path.getsize(f) for f in files) <= 20_000
    assert spark.read.text(str(tmp_path / "u")).count() == 5000


def test_one_wide_row_does_not_shrink_the_units(spark, tmp_path):
    import glob

    df = spark.range(2000).select("id", F.when(F.col("id") == 7, F.repeat(F.lit("y"), 400_000)).otherwise(F.repeat(F.lit("x"), 100)).alias("text"))
    assert sinks.size_capped_write(df, str(tmp_path / "u"), "id", max_bytes=100_000)["oversized"] == 1
    assert len(glob.glob(str(tmp_path / "u" / "*" / "*.txt"))) <= 20
    assert spark.read.text(str(tmp_path / "u")).count() == 2000


def test_otlp_text_is_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_REQUESTS", 2, raising=False)
    rows = [(T0, f"t{i}", f"s{i}", None, None, "span", "app", None, None, "n", 1, None, None, "hot", "prod", None) for i in range(200)]
    sinks.write_otlp(spark.createDataFrame(rows, SPAN), str(tmp_path / "otlp"), max_spans=10)
    files = list((tmp_path / "otlp").glob("part-*"))
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    lines = [gzip.open(f, "rt").read().splitlines() for f in files]
    assert all(len(x) <= 2 for x in lines)
    assert sum(len(s["spans"]) for x in lines for line in x for r in json.loads(line)["resourceSpans"] for s in r["scopeSpans"]) == 200
