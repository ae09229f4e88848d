"""Ordered look-ups per key that stay spread out when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` sends all rows of a hot key to one task.  Here time is cut into chunks:
rows are windowed per (key, chunk), and what crosses a chunk border travels in a summary with one row per
(key, chunk), built by a map-side combined aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import all_of
from skyledger.functions.timebucket import micros

_CHUNK = "__chunk"


def _with_chunk(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    return df.withColumn(_CHUNK, F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long"))


def _carry(summary: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """For each (key, chunk): ``value`` of the latest earlier chunk that has one."""
    w = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, _CHUNK, F.last(value, ignorenulls=True).over(w).alias(out))


def _join_chunk(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    renamed = carried.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], F.col(_CHUNK).alias("__r_chunk"),
        *[c for c in carried.columns if c not in keys and c != _CHUNK],
    )
    cond = all_of([F.col(_CHUNK) == F.col("__r_chunk")] + [F.col(k) == F.col(f"__r_{k}") for k in keys])
    return rows.join(renamed, cond, "left").drop("__r_chunk", *[f"__r_{k}" for k in keys])


def with_previous(
    df: DataFrame, keys: list[str], ts: str, values: list[str], tie: list[str], chunk_seconds: int = 3600
) -> DataFrame:
    """Add ``prev_<value>``: the value on the preceding row of the key, by (ts, tie).  Rows with a NULL key are dropped."""
    rows = _with_chunk(df.na.drop(subset=keys), ts, chunk_seconds)
    order = F.struct(ts, *tie)
    payload = F.struct(*values)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(ts, *tie)
    inside = rows.withColumn("__in", F.lag(payload).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    summary = rows.groupBy(*keys, _CHUNK).agg(F.max_by(payload, order).alias("__last"))
    joined = _join_chunk(inside, _carry(summary, keys, "__last", "__before"), keys)
    prev = F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__in"))
    return joined.withColumns({f"prev_{v}": prev.getField(v) for v in values}).drop(
        "__in", "__first", "__before", _CHUNK
    )


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    values: list[str],
    tie: str,
    tolerance_seconds: int,
    left_ts: str = "ts",
    right_ts: str = "ts",
    prefix: str = "src_",
    chunk_seconds: int = 600,
) -> DataFrame:
    """For each left row the latest right row of the same key at or before it, at most the tolerance older.

    No pair of rows is formed.  Left columns are kept; ``values`` and the matched time come back prefixed.
    Rows with a NULL key match nothing.
    """
    payload = F.struct(F.col(right_ts).alias("__at"), F.col(tie).alias("__tie"), *values)
    names = left.columns
    lrows = _with_chunk(left.withColumn("__lid", F.struct(*names)), left_ts, chunk_seconds).select(
        *keys, _CHUNK, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), "__lid", F.lit(None).alias("__hit")
    )
    events = _with_chunk(right.na.drop(subset=keys) if keys else right, right_ts, chunk_seconds)
    rrows = events.select(*keys, _CHUNK, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__lid"), payload.alias("__hit"))
    both = rrows.unionByName(lrows)
    w = Window.partitionBy(*keys, _CHUNK).orderBy("__t", "__side", "__hit").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__in", F.last("__hit", ignorenulls=True).over(w)).filter(F.col("__side") == 1)
    summary = both.groupBy(*keys, _CHUNK).agg(F.max("__hit").alias("__last"))
    joined = _join_chunk(inside, _carry(summary, keys, "__last", "__before"), keys)
    hit = F.coalesce("__in", "__before")
    fresh = F.when(micros(hit.getField("__at")) >= micros("__t") - F.lit(tolerance_seconds * 1_000_000), hit)
    out = joined.select("__lid.*", fresh.alias("__h"))
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("__h.__at").alias(f"{prefix}ts"),
        *[F.col("__h").getField(v).alias(f"{prefix}{v}") for v in values],
    )


def running_until(
    probes: DataFrame,
    events: DataFrame,
    keys: list[str],
    value: Column,
    combine: str,
    probe_ts: str,
    event_ts: str,
    out: str,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Add ``out``: the sum or max (``combine``) of ``value`` over the key's events at or before the probe's time."""
    fn = getattr(F, combine)
    names = probes.columns
    p = _with_chunk(probes.withColumn("__lid", F.struct(*names)), probe_ts, chunk_seconds).select(
        *keys, _CHUNK, F.col(probe_ts).alias("__t"), F.lit(1).alias("__side"), "__lid", F.lit(None).alias("__n")
    )
    e = _with_chunk((events.na.drop(subset=keys) if keys else events).withColumn("__n", value), event_ts, chunk_seconds)
    e = e.select(*keys, _CHUNK, F.col(event_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__lid"), "__n")
    both = e.unionByName(p)
    w = Window.partitionBy(*keys, _CHUNK).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__in", fn("__n").over(w)).filter(F.col("__side") == 1)
    summary = both.groupBy(*keys, _CHUNK).agg(fn("__n").alias("__part"))
    cw = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, _CHUNK, fn("__part").over(cw).alias("__before"))
    joined = _join_chunk(inside, carried, keys)
    if combine == "sum":
        total = F.coalesce(F.col("__in"), F.lit(0)) + F.coalesce(F.col("__before"), F.lit(0))
    else:
        total = F.greatest("__in", "__before")
    return joined.select("__lid.*", total.alias(out))


def counts_until(
    probes: DataFrame, events: DataFrame, keys: list[str], probe_ts: str, event_ts: str, out: str, chunk_seconds: int = 3600
) -> DataFrame:
    """Add ``out``: how many events of the key happened at or before the probe's time."""
    one = F.lit(1).cast("long")
    return running_until(probes, events, keys, one, "sum", probe_ts, event_ts, out, chunk_seconds)


def interval_total(
    left: DataFrame,
    events: DataFrame,
    keys: list[str],
    before: int,
    out: str,
    after: int = 0,
    value: Column | None = None,
    row_id: str = "id",
    left_ts: str = "ts",
    event_ts: str = "ts",
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Add ``out``: count (or sum of whole-number ``value``) of the key's events in [t - before, t + after] seconds of each row.

    Two running totals are read per row and subtracted, so the cost does not grow with the number of events in the
    interval.  ``row_id`` must be unique in ``left``.
    """
    base = left.select(F.col(row_id).alias("__id"), *keys, micros(left_ts).alias("__us"))
    ends = F.array(
        F.struct(F.timestamp_micros(F.col("__us") + F.lit(after * 1_000_000)).alias("at"), F.lit(1).alias("sign")),
        F.struct(F.timestamp_micros(F.col("__us") - F.lit(before * 1_000_000 + 1)).alias("at"), F.lit(-1).alias("sign")),
    )
    probes = base.select("__id", *keys, F.explode(ends).alias("p")).select(
        "__id", *keys, F.col("p.at").alias("__at"), F.col("p.sign").alias("__sign")
    )
    amount = F.lit(1).cast("long") if value is None else value
    counted = running_until(probes, events, keys, amount, "sum", "__at", event_ts, "__c", chunk_seconds)
    per_row = counted.groupBy("__id").agg(F.sum(F.col("__c") * F.col("__sign")).cast("long").alias(out))
    return left.join(per_row, left[row_id] == per_row["__id"], "left").drop("__id")


def trailing_count(left: DataFrame, events: DataFrame, keys: list[str], seconds: int, out: str, **options) -> DataFrame:
    """Add ``out``: events of the key in the closed trailing interval [t - seconds, t] of each left row."""
    return interval_total(left, events, keys, seconds, out, **options)


def numbered(df: DataFrame, keys: list[str], ts: str, tie: list[str], out: str, chunk_seconds: int = 3600) -> DataFrame:
    """Add ``out``: the row's 1-based position in its key by (ts, tie).  Rows with a NULL key are dropped."""
    rows = _with_chunk(df.na.drop(subset=keys), ts, chunk_seconds)
    inside = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*keys, _CHUNK).orderBy(ts, *tie)))
    summary = rows.groupBy(*keys, _CHUNK).agg(F.count("*").alias("__part"))
    cw = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, _CHUNK, F.sum("__part").over(cw).alias("__before"))
    position = (F.col("__in") + F.coalesce("__before", F.lit(0))).cast("long")
    return _join_chunk(inside, carried, keys).withColumn(out, position).drop("__in", "__before", _CHUNK)


#: Time is cut at so many bits of microseconds: about a second, and 65,536 of those.
_SECOND_BITS, _CHUNK_BITS = 20, 16


def previous_rows(df: DataFrame, keys: list[str], ts: str, tie: str, values: list[str], n: int, seconds: int, out: str) -> DataFrame:
    """Add ``out``: up to ``n`` preceding rows of the key within ``seconds``, newest first, as structs of (ts, tie, values).

    Rows of one second of a key are ordered together.  What earlier seconds hand on is the newest ``n`` rows of each, and what earlier chunks
    of 65,536 seconds hand on the newest ``n`` of those, so neither a busy minute nor a long history meets in one task and no pairs are formed.
    """
    names = list(dict.fromkeys([ts, tie, *values]))
    payload = F.struct(*names)
    rows = df.na.drop(subset=keys).withColumn("__second", F.shiftright(micros(ts), _SECOND_BITS))
    second, chunk = [*keys, "__second"], [*keys, "__chunk"]
    newest_first = lambda by: Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(tie))
    before = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    inside = rows.withColumn("__in", F.collect_list(payload).over(before(second, [ts, tie])))

    # A row stands for its place in time as (ts, tie, ...), so arrays of rows sort by time.
    latest = lambda many: F.slice(F.sort_array(F.flatten(many), asc=False), 1, n)
    tail = rows.withColumn("__rn", F.row_number().over(newest_first(second))).filter(F.col("__rn") <= n)
    by_second = tail.groupBy(*second).agg(F.collect_list(payload).alias("__tail")).withColumn("__chunk", F.shiftright("__second", _CHUNK_BITS))
    carried = by_second.select(*chunk, "__second", latest(F.collect_list("__tail").over(before(chunk, ["__second"]))).alias("__seconds"))
    last_seconds = by_second.withColumn("__rn", F.row_number().over(Window.partitionBy(*chunk).orderBy(F.desc("__second")))).filter(F.col("__rn") <= n)
    by_chunk = last_seconds.groupBy(*chunk).agg(latest(F.collect_list("__tail")).alias("__tail"))
    older = by_chunk.select(*chunk, latest(F.collect_list("__tail").over(before(keys, ["__chunk"]))).alias("__chunks"))
    known = carried.join(older, chunk).select(*second, F.concat("__seconds", "__chunks").alias("__before"))

    joined = inside.join(known, second, "left")
    both = F.concat("__in", F.coalesce("__before", F.slice("__in", 1, 0)))
    found = F.slice(F.sort_array(both, asc=False), 1, n)
    since = micros(ts) - F.lit(seconds * 1_000_000)
    near = F.filter(found, lambda r: micros(r.getField(ts)) >= since)
    return joined.withColumn(out, near).select(*df.columns, out)


def in_overlapping_spans(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Copy each row to its own span and to the one before, for forward searches of at most ``seconds``.

    A search that starts in ``__span`` = ``__own`` sees everything it may need inside one group; the group's
    size is bounded by two spans of time, not by the key's whole history.
    """
    own = F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")
    return df.withColumn("__own", own).withColumn("__span", F.explode(F.array(F.col("__own"), F.col("__own") - 1)))


def exact_percentiles(df: DataFrame, keys: list[str], column: str, points: dict[str, float], chunk_width: int | None = None) -> DataFrame:
    """Interpolated percentiles of a whole-number column, exact and without gathering a group in one task.

    Equal values are counted first; ranks are running counts inside value chunks plus the counts of lower chunks.  The
    default width is the root of the value range, so both chunks and the summary of chunks stay near that size.
    """
    if chunk_width is None:
        ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        chunk_width = max(1, math.isqrt(int((ends["hi"] or 0) - (ends["lo"] or 0))))
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    counted = counted.withColumn(_CHUNK, F.floor(F.col(column) / F.lit(chunk_width)).cast("long"))
    w = Window.partitionBy(*keys, _CHUNK).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    inside = counted.withColumn("__in", F.sum("__n").over(w))
    summary = counted.groupBy(*keys, _CHUNK).agg(F.sum("__n").alias("__part"))
    whole = Window.partitionBy(*keys)
    below = whole.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, _CHUNK, F.sum("__part").over(below).alias("__before"), F.sum("__part").over(whole).alias("__total")
    )
    ranked = _join_chunk(inside, carried, keys).withColumn("__hi", F.col("__in") + F.coalesce("__before", F.lit(0)))
    covers = lambda pos: (F.col("__hi") >= pos) & (F.col("__hi") - F.col("__n") < pos)
    aggs = [F.max("__total").alias("__count")]
    for name, p in points.items():
        at = (F.col("__total") - 1) * F.lit(float(p)) + 1
        aggs.append(F.max(F.when(covers(F.floor(at)), F.col(column))).alias(f"{name}__lo"))
        aggs.append(F.max(F.when(covers(F.ceil(at)), F.col(column))).alias(f"{name}__up"))
    grouped = ranked.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in points.items():
        at = (F.col("__count") - 1) * F.lit(float(p))
        lo, up = F.col(f"{name}__lo"), F.col(f"{name}__up")
        out.append((lo + (at - F.floor(at)) * (up - lo)).cast("double").alias(name))
    return grouped.select(*keys, *out, F.col("__count").alias("throughput"))
