"""Sinks: tables by stream, create-only appends, size-capped units, dead letters, metric series, OTLP text, enriched alerts.

Writers cluster rows with a rebalance hint: adaptive execution merges small and splits large write partitions, so one
stream that holds most of the rows is still written by many tasks.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.operators.traces import group_resource_spans, otlp_requests
from skyledger.sources.routing import stream_parts

MAX_UNIT_BYTES = 5 * 1024 * 1024


def write_by_stream(df: DataFrame, root: str, target: str = "target", ts: str = "ts") -> None:
    """Append every row to the table of its target stream: folders by signal, dataset and date."""
    rows = df.withColumns({**stream_parts(F.col(target)), "date": F.col(ts).cast("date")}).drop(target)
    rows.hint("rebalance", "signal", "dataset", "date").write.mode("append").partitionBy("signal", "dataset", "date").parquet(root)


def append_new(df: DataFrame, path: str, key: str, existing: DataFrame | None) -> dict[str, int]:
    """Create-only write: rows whose key is already there, or repeated in the batch, are counted as skipped.

    A row without a key can't be there already, so each is created.  Known keys are marked and counted while the rows pass to
    the writer; the data is read once.
    """
    if df.isEmpty():
        return {"created": 0, "skipped": 0}
    seen, added = Observation("offered"), Observation("added")
    # Rows without a key get one of their own, so that none is taken for a repeat.
    own = F.when(F.col(key).isNull(), F.uuid())
    once = df.observe(seen, F.count("*").alias("n")).withColumn("__own", own).dropDuplicates([key, "__own"])
    if existing is None:
        marked = once.withColumn("__known", F.lit(None).cast("boolean"))
    else:
        marked = once.join(existing.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    counted = marked.observe(added, F.count_if(F.col("__known").isNull()).alias("n"))
    counted.filter(F.col("__known").isNull()).select(*df.columns).write.mode("append").parquet(path)
    created = added.get["n"]
    return {"created": created, "skipped": seen.get["n"] - created}


#: A key filter has so many bits per key, and a key sets so many of them, all in one bitmap: one foreign key in 400 looks known.
FILTER_BITS, KEY_BITS = 16, 4
_BITMAP_BITS = 15


def _bit_places(hashed: Column) -> Column:
    """The bits of a key in its bitmap, from a second hash."""
    g = F.xxhash64(hashed)
    return F.array(*[F.shiftrightunsigned(g, _BITMAP_BITS * i).bitwiseAND((1 << _BITMAP_BITS) - 1) for i in range(KEY_BITS)])


def _has_all(bitmap: Column, places: Column) -> Column:
    byte = lambda p: F.conv(F.hex(F.substring(bitmap, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.forall(places, lambda p: F.call_function("getbit", byte(p), (p % 8).cast("int")) == 1)


def append_filtered(df: DataFrame, path: str, key: str) -> dict[str, int]:
    """Create-only write that reads old keys only where they may repeat: counts of ``created`` and ``skipped`` rows, and the ``groups_read``.

    Every append is a group of files with a filter of its keys beside it: bitmaps, and the keys' 64-bit hashes by bitmap.  Offered keys first
    meet the bitmaps; most new keys are in none.  Those that seem known are looked up among the hashes of the groups that seem to hold them.
    Only groups with a hit are read, their keys only, and decide.  A group whose filter was never written, after a failure, is always
    read, so no known key is taken for new.  Rows without a key are always created.
    """
    spark = df.sparkSession
    offered = df.count()
    if not offered:
        return {"created": 0, "skipped": 0, "groups_read": 0}
    files, filters, sizes = (f"{path}/{part}" for part in ("rows", "filters", "sizes"))
    own = F.when(F.col(key).isNull(), F.uuid())
    once = df.withColumn("__own", own).dropDuplicates([key, "__own"]).drop("__own")
    groups = _groups_of(spark, files)
    known = {r["group"]: r["bitmap_bits"] for r in spark.read.parquet(sizes).collect()} if groups and _groups_of(spark, sizes) else {}
    asked = [g for g in groups if g not in known]
    if known:
        asked += _may_repeat(spark, once.select(key).where(F.col(key).isNotNull()), key, filters, known)
    if asked:
        old = spark.read.schema(df.schema).parquet(*[f"{files}/group={g}" for g in asked]).select(F.col(key).alias("__old")).distinct()
        fresh = once.join(old, F.col(key) == F.col("__old"), "left_anti")
    else:
        fresh = once
    group = f"g{uuid.uuid4().hex}"  # never read as a number
    fresh.select(*df.columns).write.parquet(f"{files}/group={group}")
    created = spark.read.schema(df.schema).parquet(f"{files}/group={group}").count()
    bitmap_bits = max(0, (created * FILTER_BITS >> _BITMAP_BITS).bit_length())
    mine = spark.read.schema(df.schema).parquet(f"{files}/group={group}").where(F.col(key).isNotNull()).select(F.xxhash64(F.col(key)).alias("h"))
    placed = mine.select("h", F.col("h").bitwiseAND((1 << bitmap_bits) - 1).alias("bucket"), F.explode(_bit_places(F.col("h"))).alias("place"))
    bitmaps = placed.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"), F.collect_set("h").alias("hashes"))
    bitmaps.write.parquet(f"{filters}/group={group}")
    spark.createDataFrame([(bitmap_bits,)], "bitmap_bits int").coalesce(1).write.parquet(f"{sizes}/group={group}")
    return {"created": created, "skipped": offered - created, "groups_read": len(asked)}


def _groups_of(spark: SparkSession, files: str) -> list[str]:
    """The appends whose files are there, from the names of folders alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(files)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    done = lambda p: system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(s.getPath().getName().removeprefix("group=") for s in system.listStatus(folder) if s.getPath().getName().startswith("group=") and done(s.getPath()))


def _may_repeat(spark: SparkSession, keys: DataFrame, key: str, filters: str, known: dict[str, int]) -> list[str]:
    """Groups that hold the hash of some offered key; ``known`` gives the groups with a filter and the bits of its number of bitmaps."""
    sizes = spark.createDataFrame(list(known.items()), "group string, bitmap_bits int")
    stored = spark.read.parquet(filters).where(F.col("group").isin(list(known))).join(F.broadcast(sizes), "group")
    offered = keys.select(F.xxhash64(F.col(key)).alias("h")).distinct()
    probes = offered.select("h", F.explode(F.array(*[F.lit(b) for b in sorted(set(known.values()))])).alias("bitmap_bits"))
    probes = probes.withColumn("bucket", F.col("h").bitwiseAND(F.expr("shiftleft(1L, bitmap_bits) - 1")))
    seem = probes.join(stored.select("group", "bitmap_bits", "bucket", "bitmap"), ["bitmap_bits", "bucket"]).where(_has_all(F.col("bitmap"), _bit_places(F.col("h"))))
    hits = seem.select("group", "bucket", "h").join(stored.select("group", "bucket", "hashes"), ["group", "bucket"]).where(F.expr("array_contains(hashes, h)"))
    return sorted(r["group"] for r in hits.select("group").distinct().collect())


#: Units of one folder, about.
FOLDER_UNITS = 256


def size_capped_write(df: DataFrame, path: str, spread_by: str, max_bytes: int = MAX_UNIT_BYTES) -> dict[str, int]:
    """Write JSON text in files of at most ``max_bytes``; returns the number of planned ``groups`` and of ``oversized`` rows.

    One aggregate sizes the data.  Rows are hash-spread over groups of about a unit; a running sum of bytes inside a group, which never
    leaves its task, cuts it where a unit is full.  A unit's lines become one row and a row becomes one file, some hundred to a folder.  Rows
    wider than a quarter of the cap are units of their own, so a running sum overshoots by less than that; a row wider than the cap is
    counted.
    """
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"), F.col(spread_by).alias("__k")).withColumn("__size", F.octet_length("value") + 1)
    size = lines.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("total"), F.count_if(F.col("__size") > max_bytes).alias("oversized")).first()
    groups = max(1, math.ceil(size["total"] / max_bytes))
    wide = F.col("__size") * 4 > max_bytes
    grouped = lines.withColumn("__group", F.pmod(F.xxhash64("__k"), F.lit(groups)))
    # Rows of a group are ordered by a hash of the text: a sum needs some order, and texts are long to sort.
    before = F.sum("__size").over(Window.partitionBy("__group").orderBy(F.xxhash64("value")).rowsBetween(Window.unboundedPreceding, -1))
    cut = F.floor(F.coalesce(before, F.lit(0)) * 4 / F.lit(3 * max_bytes))
    narrow = grouped.filter(~wide).withColumn("__cut", cut).groupBy("__group", "__cut").agg(F.concat_ws("\n", F.collect_list("value")).alias("value"))
    units = narrow.select("__group", "value").unionByName(grouped.filter(wide).select("__group", "value"))
    placed = units.select(F.floor(F.col("__group") / FOLDER_UNITS).alias("folder"), "value")
    placed.write.mode("append").option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
    return {"groups": groups, "oversized": size["oversized"]}


def dead_letter(df: DataFrame, failed: str = "failure") -> tuple[DataFrame, DataFrame]:
    """Sound rows, and failed rows with the error, the kind ``pipeline_error`` and the tag that keeps the original."""
    bad = F.col(failed).isNotNull()
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in df.columns else F.array().cast("array<string>")
    letters = df.filter(bad).withColumns({
        "error.message": F.col(failed), "event.kind": F.lit("pipeline_error"), "tags": F.array_union(tags, F.array(F.lit("preserve_original_event"))),
    })
    return df.filter(~bad).drop(failed), letters.drop(failed)


def write_metric_series(df: DataFrame, path: str, ts: str = "ts", dims: str = "dims") -> None:
    """Metric rows partitioned by metric and date, ordered by series and time inside each file."""
    entries = F.array_sort(F.map_entries(dims))
    rows = df.withColumns({"date": F.col(ts).cast("date"), "dims_hash": F.xxhash64(entries)})
    rows.hint("rebalance", "metric", "date").sortWithinPartitions("metric", "date", "dims_hash", ts).write.mode("append").partitionBy("metric", "date").parquet(path)


#: Requests of one file: a compressed file is read by one task.
FILE_REQUESTS = 1000


def write_otlp(df: DataFrame, path: str, max_spans: int = 250) -> None:
    """Trace documents as OTLP/JSON export requests, one per line of gzip text, which repeats its field names and so packs to a fraction."""
    requests = otlp_requests(group_resource_spans(df, max_spans))
    requests.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", FILE_REQUESTS).text(path)


def write_enriched_alerts(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Enriched alerts as an enrichment stream, by date."""
    rows = df.withColumns({"date": F.col(ts).cast("date"), "kind": F.lit("enrichment"), "stream_dataset": F.lit("security.alert.enriched")})
    rows.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)
