"""Bucketed anomaly detection.

Events are first aggregated to one row per time bucket and partition value; baselines and scores run on those rows only,
so a window never orders raw events.  The score is this library's own definition:
``z = (x - mean) / max(sd, eps)`` over the previous ``history`` buckets (8 at least), ``score = 100 (1 - exp(-max(z - 2, 0) / 3))``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import all_of, as_col, wildcard
from skyledger.functions.timebucket import bucket

SPAN = "15 minutes"
EPS = 1e-9


def datafeed_filter(
    terms: dict[str, object] | None = None, prefixes: dict[str, str] | None = None, exists: list[str] | None = None,
    wildcards: dict[str, str] | None = None,
) -> Column:
    """All of: equal values, prefixes, present fields, wildcard matches."""
    parts = [as_col(k) == v for k, v in (terms or {}).items()]
    parts += [as_col(k).startswith(v) for k, v in (prefixes or {}).items()]
    parts += [as_col(k).isNotNull() for k in exists or []]
    parts += [wildcard(k, v) for k, v in (wildcards or {}).items()]
    return all_of(parts) if parts else F.lit(True)


def bucketise(df: DataFrame, aggs: dict[str, Column], by: list[str] | None = None, span: str = SPAN, where: Column | None = None, ts: str = "ts") -> DataFrame:
    """Aggregates per bucket and partition value."""
    kept = df if where is None else df.filter(where)
    return kept.groupBy(bucket(ts, span).alias("bucket"), *(by or [])).agg(*[v.alias(k) for k, v in aggs.items()])


def _last_bucket(as_of: str | None, span: str) -> Column:
    """The last whole bucket before ``as_of``; NULL without it."""
    return F.lit(None).cast("timestamp") if as_of is None else bucket(F.lit(as_of).cast("timestamp"), span) - F.expr(f"INTERVAL {span}")


def fill_empty(series: DataFrame, value: str, by: list[str], span: str = SPAN, as_of: str | None = None) -> DataFrame:
    """Zero rows for a partition's empty buckets: between its first and last one and, with ``as_of``, after the last one up to then."""
    step = F.expr(f"INTERVAL {span}")
    nxt = F.lead("bucket").over(Window.partitionBy(*by).orderBy("bucket"))
    to = F.coalesce(nxt - step, F.greatest("bucket", _last_bucket(as_of, span)))
    rows = series.withColumn("__to", to).withColumn("__at", F.explode(F.sequence(F.col("bucket"), F.col("__to"), step)))
    filled = F.when(F.col("__at") == F.col("bucket"), F.col(value)).otherwise(F.lit(0))
    return rows.select(F.col("__at").alias("bucket"), *by, filled.alias(value))


def score(series: DataFrame, value: str, by: list[str] | None = None, side: str = "high", history: int = 24, minimum: int = 8) -> DataFrame:
    """One-sided score of each bucket against the partition's preceding buckets; rows with a positive score."""
    keys = by or []
    rows = series if keys else series.withColumn("__all", F.lit(1))
    w = Window.partitionBy(*(keys or ["__all"])).orderBy("bucket").rowsBetween(-history, -1)
    stats = rows.withColumns({"mean": F.avg(value).over(w), "sd": F.stddev(value).over(w), "seen": F.count(value).over(w)})
    ready = stats.filter(F.col("seen") >= minimum)
    gap = F.col(value) - F.col("mean") if side == "high" else F.col("mean") - F.col(value)
    z = gap / F.greatest(F.col("sd"), F.lit(EPS))
    points = F.round(100 * (1 - F.exp(-F.greatest(z - 2, F.lit(0.0)) / 3)), 3)
    out = ready.withColumn("anomaly_score", points).filter(F.col("anomaly_score") > 0)
    return out.select("bucket", *keys, F.col(value).cast("double").alias("actual"), "anomaly_score")


def high_mean(df: DataFrame, column: str, by: list[str] | None = None, **options) -> DataFrame:
    """Mean above its baseline."""
    return _detect(df, F.avg(column), by, "high", False, **options)


def high_count(df: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
    """Event count above its baseline; an empty bucket counts zero."""
    return _detect(df, F.count("*"), by, "high", True, **options)


def low_count(df: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
    """Throughput drop; with ``as_of`` a key that has gone silent is scored up to then."""
    return _detect(df, F.count("*"), by, "low", True, **options)


def low_mean(df: DataFrame, column: str, by: list[str] | None = None, **options) -> DataFrame:
    """Mean below its baseline."""
    return _detect(df, F.avg(column), by, "low", False, **options)


def high_sum(df: DataFrame, column: str, by: list[str] | None = None, **options) -> DataFrame:
    """Sum above its baseline."""
    return _detect(df, F.sum(column), by, "high", False, **options)


def high_max(df: DataFrame, column: str, by: list[str] | None = None, **options) -> DataFrame:
    """Maximum above its baseline."""
    return _detect(df, F.max(column), by, "high", False, **options)


def _detect(df, agg, by, side, fill, span=SPAN, where=None, history=24, minimum=8, as_of=None):
    series = bucketise(df, {"x": agg}, by, span, where)
    if fill:
        base = series if by else series.withColumn("__all", F.lit(1))
        series = fill_empty(base, "x", by or ["__all"], span, as_of)
    return score(series, "x", by, side, history, minimum)


def rare(df: DataFrame, column: str, by: list[str] | None = None, span: str = SPAN, max_share: float = 0.05, where: Column | None = None, ts: str = "ts") -> DataFrame:
    """Values seen in a small share of the (partition's) buckets, with their first sight."""
    keys = by or []
    kept = df if where is None else df.filter(where)
    seen = kept.groupBy(*keys, column, bucket(ts, span).alias("bucket")).agg(F.count("*").alias("events"), F.min(ts).alias("first"))
    per_value = seen.groupBy(*keys, column).agg(
        F.count("*").alias("buckets_seen"), F.sum("events").alias("events"), F.min("first").alias("first_seen")
    )
    totals = seen.select(*keys, "bucket").distinct()
    if keys:
        totals = totals.groupBy(*keys).agg(F.count("*").alias("buckets_total"))
        joined = per_value.join(totals, keys)
    else:
        joined = per_value.withColumn("buckets_total", totals.agg(F.count("*")).scalar())
    share = F.col("buckets_seen") / F.col("buckets_total")
    return joined.filter(share <= max_share)


def influencers(anomalies: DataFrame, raw: DataFrame, by: list[str], columns: list[str], span: str = SPAN, top: int = 3, ts: str = "ts") -> DataFrame:
    """For each anomaly the values that make up most of its rows, per influencer column."""
    rows = raw.withColumn("bucket", bucket(ts, span)).join(anomalies.select("bucket", *by), ["bucket", *by])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    counted = rows.select("bucket", *by, pairs.alias("p")).groupBy("bucket", *by, "p.field", "p.value").agg(F.count("*").alias("rows"))
    w = Window.partitionBy("bucket", *by, "field").orderBy(F.desc("rows"), F.asc_nulls_last("value"))
    # Every row has one value of each field, so a field's counts add up to the rows of the bucket.
    total = F.sum("rows").over(Window.partitionBy("bucket", *by, "field"))
    return counted.withColumns({"rank": F.row_number().over(w), "share": F.round(F.col("rows") / total, 4)}).filter(F.col("rank") <= top)


def anomaly_bands(results: DataFrame) -> DataFrame:
    """Above 75 critical, above 50 warning, else minor."""
    s = F.col("anomaly_score")
    return results.withColumn("band", F.when(s > 75, "critical").when(s > 50, "warning").otherwise("minor"))


@dataclass(frozen=True)
class Job:
    """One anomaly job: which rows, which function on which field, per which partition."""

    id: str
    where: str
    function: str
    column: str | None = None
    by: str | None = None


# Representative jobs of the catalogue, one or more per detector function.
JOBS: tuple[Job, ...] = (
    Job("aws-vpcflow-high-bytes-tx", "direction = 'egress'", "high_sum", "bytes", "dst_ip"),
    Job("aws-vpcflow-high-denied-count", "outcome = 'failure'", "high_count", None, "src_ip"),
    Job("aws-guardduty-finding-spike", "kind = 'alert'", "high_count", None, "severity"),
    Job("aws-waf-high-block-rate", "rule_category = 'dns_firewall'", "high_count", None, "src_ip"),
    Job("aws-nlb-unhealthy-host-spike", "host IS NOT NULL", "high_mean", "duration_ms", "host"),
    Job("aws-lambda-duration-spike", "duration_ms IS NOT NULL", "high_max", "duration_ms", "dag_id"),
    Job("aws-stream-throughput-drop", "bytes IS NOT NULL", "low_count", None, "dataset"),
)
RARE_JOBS: tuple[Job, ...] = (
    Job("aws-guardduty-rare-finding-type", "kind = 'alert'", "rare", "finding_type"),
    Job("aws-cloudtrail-rare-user-action", "action IS NOT NULL", "rare", "action", "user_name"),
    Job("aws-kms-unusual-operation", "action IS NOT NULL", "rare", "action", "account"),
)

def job_buckets(df: DataFrame, jobs: tuple[Job, ...], span: str = SPAN, ts: str = "ts") -> DataFrame:
    """The buckets of all jobs in one scan and one shuffle: every row is tagged with the jobs it feeds."""
    tags = [
        F.when(F.expr(j.where), F.struct(
            F.lit(j.id).alias("job_id"), F.lit(j.function).alias("function"),
            (F.col(j.by).cast("string") if j.by else F.lit("*")).alias("partition_value"),
            (F.col(j.column).cast("double") if j.column else F.lit(None).cast("double")).alias("v"),
        )) for j in jobs
    ]
    rows = df.select(bucket(ts, span).alias("bucket"), F.explode(F.array_compact(F.array(*tags))).alias("t")).select("bucket", "t.*")
    grouped = rows.groupBy("job_id", "function", "partition_value", "bucket").agg(
        F.count("*").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.max("v").alias("top")
    )
    f = F.col("function")
    x = F.when(f == "high_sum", F.col("total")).when(f.isin("high_mean", "low_mean"), F.col("mean")).when(f == "high_max", F.col("top")).otherwise(F.col("n").cast("double"))
    return grouped.select("job_id", "function", "partition_value", "bucket", x.alias("x"))


def run_jobs(df: DataFrame, jobs: tuple[Job, ...] = JOBS, span: str = SPAN, as_of: str | None = None) -> DataFrame:
    """All metric jobs as one result table: job_id, partition value, bucket, score.

    Count jobs see empty buckets as zero, with ``as_of`` also those after a partition's last event.
    """
    return score_job_series(job_buckets(df, jobs, span), span, as_of)


def score_job_series(series: DataFrame, span: str = SPAN, as_of: str | None = None) -> DataFrame:
    """Scores of ``job_id, function, partition_value, bucket, x``; empty buckets of counts are zeros."""
    keys = ["job_id", "function", "partition_value"]
    counts = F.col("function").endswith("_count")
    step = F.expr(f"INTERVAL {span}")
    upto = F.coalesce(F.lead("bucket").over(Window.partitionBy(*keys).orderBy("bucket")) - step, F.greatest("bucket", _last_bucket(as_of, span)))
    spine = series.withColumn("__to", F.when(counts, upto).otherwise(F.col("bucket"))).withColumn(
        "__at", F.explode(F.sequence(F.col("bucket"), F.col("__to"), step))
    )
    filled = spine.select(F.col("__at").alias("bucket"), *keys, F.when(F.col("__at") == F.col("bucket"), F.col("x")).otherwise(0.0).alias("x"))
    turned = filled.withColumn("y", F.when(F.col("function").startswith("low_"), -F.col("x")).otherwise(F.col("x")))
    found = score(turned, "y", keys)
    actual = F.when(F.col("function").startswith("low_"), -F.col("actual")).otherwise(F.col("actual"))
    return found.select("job_id", "partition_value", F.col("bucket").alias("ts"), actual.alias("actual"), "anomaly_score")


def run_rare_jobs(df: DataFrame, jobs: tuple[Job, ...] = RARE_JOBS, span: str = SPAN, max_share: float = 0.05) -> DataFrame:
    """All rarity jobs in one scan: values seen in a small share of their partition's buckets."""
    tags = [
        F.when(F.expr(j.where), F.struct(
            F.lit(j.id).alias("job_id"), (F.col(j.by).cast("string") if j.by else F.lit("*")).alias("partition_value"),
            F.col(j.column).cast("string").alias("value"),
        )) for j in jobs
    ]
    rows = df.select("ts", F.explode(F.array_compact(F.array(*tags))).alias("t")).select("ts", "t.*")
    return rare(rows, "value", ["job_id", "partition_value"], span, max_share)


def multi_detector(results: dict[str, DataFrame]) -> DataFrame:
    """Several detectors of one job in one result, told apart by name."""
    return reduce(DataFrame.unionByName, [r.withColumn("detector", F.lit(name)) for name, r in results.items()])
