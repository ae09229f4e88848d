"""Normalisation steps on literal rows."""

from pyspark.sql import functions as F

from skyledger.functions import fixed_values as fx
from skyledger.operators import normalize as n


def lines(spark, *texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, message string")
    for k, v in more.items():
        df = df.withColumn(k.replace("__", "."), v if not isinstance(v, str) else F.lit(v))
    return n.parse_json(n.preserve_original(df))


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(F.col(f"`{column}`")).collect()]


def test_json_only_objects_parse(spark):
    df = lines(spark, '{"a":1}', "plain", '{"a":', "", None, "[1]")
    assert [p is not None for p in values(df, "parsed")] == [True, False, False, False, False, False]
    assert values(df, "event.original") == ['{"a":1}', "plain", '{"a":', "", None, "[1]"]


def test_first_alias_wins_and_target_is_kept(spark):
    df = lines(spark, '{"jobId":"a","job_id":"b"}', '{"job_id":"b"}', "{}")
    assert values(n.rename_first_wins(df, "job", "jobId", "job_id"), "job") == ["a", "b", None]
    kept = n.rename_first_wins(df.withColumn("job", F.lit("old")), "job", "jobId")
    assert values(kept, "job") == ["old", "old", "old"]


def test_log4j_level_needs_the_group_and_no_json(spark):
    text = "2024-01-01 10:00:00,123 WARN [pool-1] org.acme.Job$Inner: slow"
    df = lines(spark, text, "2024-01-01T10:00:00Z ERROR broken", '{"x":1}', "no time INFO x", svc_group="compute")
    assert values(n.grok_log4j_fallback(df), "log.level") == ["WARN", "ERROR", None, None]
    other = lines(spark, text, svc_group="storage")
    assert values(n.grok_log4j_fallback(other), "log.level") == [None]


def test_lambda_lines(spark):
    report = "REPORT RequestId: r-1\tDuration: 12.34 ms\tBilled Duration: 13 ms\tMemory Size: 512 MB\tMax Memory Used: 100 MB"
    out = n.lambda_extract(lines(spark, report, "START RequestId: r-1 Version: $LATEST", "END RequestId: r-1", "other"))
    fields = values(out, "fields")
    assert fields[0] == {
        "request_id": "r-1", "duration_ms": "12.34", "billed_duration_ms": "13.0", "memory_size_mb": "512", "max_memory_used_mb": "100",
        "memory_utilization_pct": "19.53",
    }
    assert fields[1] == {"request_id": "r-1", "version": "$LATEST"}
    assert fields[2] == {"request_id": "r-1"}
    assert values(out, "event.duration") == [13000000, None, None, None]


def test_duration_first_present_key_decides(spark):
    df = lines(spark, '{"duration_ms":1.5,"elapsed_ms":9}', '{"duration_ms":0,"elapsed_ms":9}', '{"durationSeconds":2}', '{"duration_ms":"x"}')
    assert values(n.duration_ns(df), "event.duration") == [1500000, None, 2000000000, None]


def test_unknown_group_reads_as_misc_and_failure_overrides_type(spark):
    df = lines(spark, "a", "b", "c").withColumns({
        "svc_group": F.element_at(F.array(F.lit("compute"), F.lit("nope"), F.lit(None)), F.col("id") + 1),
        "event.outcome": F.when(F.col("id") == 1, "failure"),
    })
    out = n.outcome_type(n.ecs_category(df))
    assert values(out, "event.category") == [["host", "process"], ["process"], ["process"]]
    assert values(out, "event.type") == [["info"], ["error"], ["info"]]


def test_every_group_of_the_field_table_is_known():
    assert set(fx.GROUP_FIELDS) <= set(fx.GROUP_ECS)
    assert len(fx.GROUP_ECS) == 26


def test_security_severity_moves_and_is_gone_for_the_level(spark):
    df = lines(spark, '{"severity":"HIGH","level":null}', '{"severity":"LOW"}').withColumn(
        "svc_group", F.when(F.col("id") == 0, "security").otherwise("storage"))
    out = n.level_normalise(n.group_extract(df))
    assert values(out, "log.level") == [None, "low"]
    assert values(out, "fields")[0] == {"severity": "HIGH"}


def test_gcp_parsed_principal_beats_the_envelope(spark):
    proto = '{"authenticationInfo":{"principalEmail":"outer@x"},"methodName":"outer"}'
    df = lines(spark, '{"protoPayload":{"authenticationInfo":{"principalEmail":"inner@x"}}}', "text", protoPayload=proto)
    out = n.identity_gcp(df)
    assert values(out, "user.email") == ["inner@x", "outer@x"]
    assert values(out, "event.action") == ["outer", "outer"]


def test_only_for_leaves_other_rows_alone(spark):
    df = lines(spark, "a", "b").withColumn("x", F.lit("old"))
    out = n.only_for(F.col("id") == 0, lambda d: d.withColumns({"x": F.lit("new"), "y": F.lit(1)}))(df)
    assert [tuple(r) for r in out.orderBy("id").select("x", "y").collect()] == [("new", 1), ("old", None)]


def test_geo_borders_and_bad_addresses(spark):
    ranges = spark.createDataFrame([(16777216, 16777471, "AU"), (16777472, 33554431, "CN")], "ip_start long, ip_end long, country string")
    df = spark.createDataFrame([("1.0.0.0",), ("1.0.0.255",), ("1.0.1.0",), ("1.255.255.255",), ("2.0.0.0",), ("1.2.3",), ("999.1.1.1",), (None,)], "`source.ip` string")
    out = {r[0]: r[1] for r in n.geo_enrich(df, ranges).select("`source.ip`", "`source.geo.country`").collect()}
    assert out == {"1.0.0.0": "AU", "1.0.0.255": "AU", "1.0.1.0": "CN", "1.255.255.255": "CN", "2.0.0.0": None, "1.2.3": None, "999.1.1.1": None, None: None}


def test_geo_index_finds_what_a_scan_of_the_ranges_finds(spark):
    """Random disjoint ranges from one address to several blocks long, looked up at and around their borders."""
    import random

    rng = random.Random(5)
    low, ranges = 1 << 24, []
    for i in range(400):
        low += rng.choice([1, 1, 2, 500, 70_000])
        high = low + rng.choice([0, 0, 3, 255, 65_535, 200_000])
        ranges.append((low, high, f"c{i}"))
        low = high
    text = lambda x: ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    asked = sorted({x + d for a, b, _ in ranges for x in (a, b) for d in (-1, 0, 1)} | {rng.randrange(1 << 24, low) for _ in range(300)})
    df = spark.createDataFrame([(text(x), text(asked[-1 - i])) for i, x in enumerate(asked)], "`source.ip` string, `destination.ip` string").repartition(5)
    table = spark.createDataFrame(ranges, "ip_start long, ip_end long, country string")
    rows = n.geo_enrich(df, table).collect()
    of = {text(x): next((c for a, b, c in ranges if a <= x <= b), None) for x in asked}
    assert len(rows) == len(asked)
    assert all(r["source.geo.country"] == of[r["source.ip"]] and r["destination.geo.country"] == of[r["destination.ip"]] for r in rows)


def test_geo_on_a_stream_and_its_scans(spark, tmp_path):
    from skyledger.streaming import jobs

    ranges = spark.createDataFrame([(16777216, 16777471, "AU")], "ip_start long, ip_end long, country string")
    spark.createDataFrame([(1, "1.0.0.7"), (2, "9.9.9.9"), (3, None)], "id int, ip string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id int, ip string").parquet(str(tmp_path / "in")).withColumnRenamed("ip", "source.ip")
    out = n.geo_enrich(source, ranges).select("id", F.col("`source.geo.country`").alias("country"))
    jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "AU"), (2, None), (3, None)]
    rows = spark.read.parquet(str(tmp_path / "in")).withColumnRenamed("ip", "source.ip")
    plan = n.geo_enrich(rows, ranges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # the rows and the index


def test_route_map_has_both_spellings(spark):
    names = spark.createDataFrame([("aws.lambda_logs",), ("aws.glue",), ("gcp.x",)], "dataset string")
    assert sorted(tuple(r) for r in n.service_route_map(names).collect()) == [
        ("glue", "aws.glue"), ("lambda", "aws.lambda_logs"), ("lambda_logs", "aws.lambda_logs")]


def test_normalised_row_is_nested_and_empty_input_works(spark):
    df = spark.createDataFrame([("aws", "analytics", '{"jobId":"j","level":"WARN","errorMessage":"boom"}')], "vendor string, svc_group string, message string")
    out = n.normalise(df)
    row = out.first().asDict(recursive=True)
    assert row["event"]["category"] == ["database"] and row["log"]["level"] == "warn" and row["ecs"]["version"] == "9.3.0"
    assert row["tags"] == ["preserve_original_event"] and row["vendor_fields"] == {"job_id": "j"}
    assert "parsed" not in out.columns
    assert n.normalise(df.limit(0)).count() == 0


def test_gateway_labels_for_azure(spark):
    df = spark.createDataFrame([("otel-csp-edot-gateway",)], "ingestion_source string").withColumn("trace.id", F.lit("AB" * 16))
    labels = n.otel_correlation_labels(df, "azure").first()["labels"]
    assert labels["azure.application_insights.operation_id"] == "abababab-abab-abab-abab-abababababab"
    assert labels["azure.monitor.opentelemetry.dist"] == "Azure Monitor Distro"


def test_dataset_rules(spark):
    df = spark.createDataFrame([("aws.ec2", "s3", True), (None, "firehose", False), ("aws.glue", "s3", True), ("aws.glue", "s3", False), ("aws.glue", "cloudwatch", True), ("", "zzz", True)], "d string, s string, o boolean")
    out = [r[0] for r in df.select(n.normalise_dataset(F.col("d"), F.col("s"), F.col("o"))).collect()]
    assert out == ["aws.ec2_logs", "awsfirehose", "aws_logs.generic", "aws.glue", "aws.glue", "aws.cloudwatch_logs"]
