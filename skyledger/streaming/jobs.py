"""Structured Streaming jobs: normalisation, windowed detection, late data, sessions, ordered stages, joins, de-duplication.

The batch operators are reused wherever Spark allows them on a stream.  Results go to Parquet in append mode: a window or
session is written once, when the watermark has passed it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from skyledger.functions.timebucket import bucket
from skyledger.operators.anomalies import score
from skyledger.operators.detections import Rule, threshold_rule
from skyledger.operators.normalize import normalise
from skyledger.sources.routing import stream_parts

# Fixed value: how long late rows are waited for.
LATE = "120 seconds"


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``path`` may name files by a pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_continuously(df: DataFrame, path: str, checkpoint: str, every: str = "1 minute", partition_by: tuple[str, ...] = ()):
    """Start a job that goes on until it is stopped, with a batch at every interval; returns the running query."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(processingTime=every).start()


def run_available(df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()):
    """Process what is there, in append mode, to Parquet; returns the finished query for its progress figures."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Process what is there batch by batch with a function."""
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_routed(df: DataFrame, root: str, checkpoint: str, target: str = "target", ts: str = "ts"):
    """Streaming form of the write by stream: each row once to the folder of its signal, dataset and date."""
    rows = df.withColumns({**stream_parts(F.col(target)), "date": F.col(ts).cast("date")}).drop(target)
    return run_available(rows, root, checkpoint, ("signal", "dataset", "date"))


def normalise_stream(raw: DataFrame) -> DataFrame:
    """The normalisation chain on a stream; it holds no state."""
    return normalise(raw)


def detect_stream(logs: DataFrame, rule: Rule, window: str | None = None, slide: str | None = None, late: str = LATE) -> DataFrame:
    """A threshold rule over tumbling windows, or sliding ones with ``slide``; distinct values are counted by sketch."""
    return threshold_rule(logs.withWatermark("ts", late), rule, window=window, slide=slide, approx=True)


class LateRows(StreamingQueryListener):
    """Rows dropped as too late over each query's whole life.

    Progress records that a query keeps are only its last ones, so the listener adds them up as they come.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.dropped[run] = self.dropped.get(run, 0) + sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query, wait_s: float = 30.0) -> int:
        """The figure of a finished query; events arrive a little after its end."""
        run, until = str(query.runId), time.monotonic() + wait_s
        while run not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError("the query has not ended, or the listener was added after its start")
            time.sleep(0.05)
        return self.dropped.get(run, 0)


def bucket_stream(logs: DataFrame, by: list[str], span: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Event counts and mean durations per closed bucket: the table that anomaly baselines read."""
    out = logs.withWatermark("ts", late).groupBy(F.window("ts", span).alias("w"), *by).agg(
        F.count("*").alias("events"), F.sum("duration_ms").alias("total_ms")
    )
    return out.select(F.col("w.start").alias("bucket"), *by, "events", "total_ms")


def score_buckets(buckets: DataFrame, by: list[str], history: int = 24) -> DataFrame:
    """Scores of the closed buckets against their past; run over the bucket table after a batch."""
    rows = buckets.withColumn("mean_ms", F.col("total_ms") / F.col("events"))
    return score(rows, "mean_ms", by, history=history)


def attack_sessions(logs: DataFrame, key: str, gap: str, late: str = LATE) -> DataFrame:
    """Sessions of one entity's events without a label: a quiet gap ends a session.

    Sessions are merged inside each input partition before the shuffle, which thins out a busy entity.
    """
    logs.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    out = logs.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key).agg(
        F.count("*").alias("events"), F.approx_count_distinct("action").alias("actions"), F.max("ts").alias("last_event")
    )
    return out.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), key, "events", "actions", "last_event")


def minute_sources(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """The latest event per entity and minute, so that a later join meets at most one row per minute.

    The latest event carries text, so Spark sorts rows to aggregate them.  They are dealt out by entity and minute before that,
    so that a task sorts its share of them and not all that lies in one piece of a file.
    """
    payload = F.struct(F.unix_micros("ts").alias("us"), "id", "src_ip", "user_name")
    used = dict.fromkeys(("ts", key, "id", "src_ip", "user_name"))
    rows = events.withWatermark("ts", late).select(*used).repartition(F.col(key), F.date_trunc("minute", "ts"))
    out = rows.groupBy(F.window("ts", "1 minute"), key).agg(F.max(payload).alias("e"))
    return out.select(
        key, F.window_time("window").alias("minute"), F.timestamp_micros("e.us").alias("event_ts"), F.col("e.id").alias("event_id"), F.col("e.src_ip").alias("src_ip"), F.col("e.user_name").alias("event_user")
    )


def alert_audit_join(alerts: DataFrame, minutes: DataFrame, key: str = "host", late: str = LATE) -> DataFrame:
    """Alerts with the latest events of the minutes before their own, within an hour: at most 60 rows per alert.

    The join key is (entity, hour): an alert stands in its own hour and the one before, so a busy entity's state is cut
    by time and a row never meets its whole history.  Events of the alert's own minute are for ``alert_minute_join``.
    """
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600)
    a = alerts.withWatermark("ts", late).select(
        F.col("id").alias("alert_id"), F.col("ts").alias("alert_ts"), F.col(key).alias("alert_key"),
        F.explode(F.array(hour("ts"), hour("ts") - 1)).alias("alert_hour"),
    )
    m = minutes.withColumn("minute_hour", hour("event_ts"))
    since = F.col("alert_ts") - F.expr("INTERVAL 1 HOUR")
    near = (F.col("minute") >= since) & (F.col("minute") <= F.col("alert_ts"))
    before = (F.col("event_ts") < F.date_trunc("minute", "alert_ts")) & (F.col("event_ts") >= since)
    pairs = a.join(m, (F.col("alert_key") == F.col(key)) & (F.col("alert_hour") == F.col("minute_hour")) & near & before)
    return pairs.select("alert_id", "alert_ts", "alert_key", "event_ts", "event_id", "src_ip", "event_user")


def alert_minute_join(alerts: DataFrame, events: DataFrame, key: str = "host", late: str = LATE) -> DataFrame:
    """Alerts with the events of their own minute up to their instant; state is held for one minute and the delay.

    With the earlier minutes' latest events this gives every alert its exact latest event: the rest of the alert's minute
    may hold later ones that must not hide it.
    """
    minute = lambda c: F.floor(F.unix_seconds(c) / 60)
    a = alerts.withWatermark("ts", late).select(F.col("id").alias("alert_id"), F.col("ts").alias("alert_ts"), F.col(key).alias("alert_key"), minute("ts").alias("alert_minute"))
    e = events.withWatermark("ts", late).select(
        F.col("ts").alias("event_ts"), F.col("id").alias("event_id"), "src_ip", F.col("user_name").alias("event_user"), F.col(key).alias("event_key"), minute("ts").alias("event_minute")
    )
    upto = (F.col("event_ts") <= F.col("alert_ts")) & (F.col("event_ts") >= F.col("alert_ts") - F.expr("INTERVAL 1 MINUTE"))
    pairs = a.join(e, (F.col("alert_key") == F.col("event_key")) & (F.col("alert_minute") == F.col("event_minute")) & upto)
    return pairs.select("alert_id", "alert_ts", "alert_key", "event_ts", "event_id", "src_ip", "event_user")


def latest_match(pairs: DataFrame) -> DataFrame:
    """The latest audited event of each alert.

    Pairs are many times the alerts, and a maximum over text would sort them.  So only instants are compared over the pairs, in a
    hash table of one row per alert; the last event of that instant and entity is then looked up among the distinct events.  An event
    pairs with every alert of its entity that its instant allows, so the one found is the alert's own.
    """
    instant = pairs.groupBy("alert_id", "alert_key").agg(F.max("event_ts").alias("event_ts"))
    # The count comes last and decides nothing; without it Spark leaves the first step out, as a maximum needs no distinct rows.
    events = pairs.groupBy("alert_key", "event_ts", "event_id", "src_ip", "event_user").agg(F.count("*").alias("n"))
    last = events.groupBy("alert_key", "event_ts").agg(F.max(F.struct("event_id", "src_ip", "event_user", "n")).alias("l"))
    latest = instant.join(last, ["alert_key", "event_ts"])
    best = F.max(F.struct("event_ts", "l.event_id", "l.src_ip", "l.event_user")).alias("e")
    return latest.groupBy("alert_id").agg(best).select("alert_id", "e.event_ts", "e.src_ip", "e.event_user")


def with_assets(alerts: DataFrame, ci: DataFrame, key: str = "host") -> DataFrame:
    """Alerts of a stream with the newest asset of their host: a stream-static left join on one row per host."""
    newest = ci.groupBy(key).agg(F.max(F.struct("ts", "ci_id", "owner")).alias("c")).select(key, F.col("c.ci_id").alias("ci_id"), F.col("c.owner").alias("ci_owner"))
    return alerts.join(newest, key, "left")


def deduplicated(df: DataFrame, key: str = "id", delay: str = "10 minutes") -> DataFrame:
    """The first row of each id within the watermark delay."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def per_bucket(df: DataFrame, by: list[str], span: str) -> DataFrame:
    """Batch counterpart of ``bucket_stream``."""
    return df.groupBy(bucket("ts", span).alias("bucket"), *by).agg(F.count("*").alias("events"), F.sum("duration_ms").alias("total_ms"))
