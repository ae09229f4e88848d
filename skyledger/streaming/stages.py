"""Ordered stage tracker on a stream: each stage strictly after the one before, all within a time limit.

Events are keyed by a bucket of actors and by overlapping spans of the time limit, so a busy actor is spread over many keys,
a key's state holds at most two spans of its actors' events, and the cost of a key is shared by many actors.  A key buffers
events until the watermark has passed them, hence events may arrive out of order, and forgets what can no longer be completed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyledger.functions.ordered import in_overlapping_spans
from skyledger.streaming.state import Waiting

US = 1_000_000
#: Keys that the actors of one span are dealt over.
BUCKETS = 256


def advance(waiting: list[list[list[int]]], stage: int, at: int, limit: int) -> list[list[int]]:
    """Feed one event to the chains, kept by the number of stages they have; returns the chains it completes.

    Only chains that wait for this very stage are touched and each moves on once per stage, so the work is linear.
    """
    if stage == 0:
        waiting[1].append([at])
        return []
    moved, stay = [], []
    for chain in waiting[stage]:
        if at - chain[0] <= limit:
            (moved if chain[-1] < at else stay).append([*chain, at] if chain[-1] < at else chain)
    waiting[stage] = stay
    if stage + 1 == len(waiting):
        return moved
    waiting[stage + 1].extend(moved)
    return []


class StageTracker(StatefulProcessor):
    """Buffers a bucket's events until the watermark passes them, then advances each actor's chains in time order.

    Open chains are kept by actor, so that only those of actors with passed events are read and written again.
    """

    def __init__(self, stages: int, limit_seconds: int):
        self._stages = stages
        self._limit = limit_seconds * US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = Waiting(handle, {"us": "bigint", "stage": "int", "actor": "string"})
        self._chains = handle.getMapState("chains", "actor string", "times array<array<bigint>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._waiting.add(rows)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self._waiting.take(passed)
        known = self._chains.exists()
        over = (int(key[1]) + 2) * self._limit  # no chain that starts in the span can be completed after it
        actors, out = [], []
        for actor, us, stage in by_actor(rows):
            waiting: list[list[list[int]]] = [[] for _ in range(self._stages)]
            was = known and self._chains.containsKey((actor,))
            for times in self._chains.getValue((actor,))[0] if was else ():
                waiting[len(times)].append([int(x) for x in times])
            done = [c for at, k in zip(us, stage, strict=True) for c in advance(waiting, k, at, self._limit)]
            actors.extend([actor] * len(done))
            out.extend(done)
            still_open = [c for group in waiting for c in group if passed - c[0] <= self._limit]
            if still_open:
                self._chains.updateValue((actor,), (still_open,))
                if not known:
                    self._handle.registerTimer(over // 1000 + 1)
                    known = True
            elif was:
                self._chains.removeKey((actor,))
        if known and passed > over:
            self._chains.clear()
        if out:
            yield pd.DataFrame({"actor": actors, **{f"t{i + 1}": [c[i] for c in out] for i in range(self._stages)}})

    def close(self) -> None:
        pass


def by_actor(rows: pd.DataFrame) -> Iterator[tuple[str, list[int], list[int]]]:
    """Each actor's times and stages, in order of (time, stage)."""
    if rows.empty:
        return
    code, names = pd.factorize(rows["actor"])
    us, stage = rows["us"].to_numpy("int64"), rows["stage"].to_numpy("int64")
    order = np.lexsort((stage, us, code))
    us, stage = us[order].tolist(), stage[order].tolist()
    ends = np.cumsum(np.bincount(code)).tolist()
    for actor, start, end in zip(names, [0, *ends[:-1]], ends, strict=True):
        yield actor, us[start:end], stage[start:end]


def stage_stream(events: DataFrame, actor: str, stages: tuple[str, ...], limit_seconds: int, late: str = "120 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Completed stage chains per actor, with the time of each stage.  Needs the RocksDB state store."""
    stage = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("action")).cast("int") - 1
    rows = events.withWatermark("ts", late).filter(F.col("action").isin(*stages) & F.col(actor).isNotNull())
    bucket = F.pmod(F.xxhash64(actor), F.lit(buckets)).cast("int").alias("bucket")
    keyed = rows.select(bucket, F.col(actor).alias("actor"), "ts", F.unix_micros("ts").alias("us"), stage.alias("stage"))
    spread = in_overlapping_spans(keyed, "ts", limit_seconds).filter((F.col("stage") > 0) | (F.col("__own") == F.col("__span")))
    names = [f"t{i + 1}" for i in range(len(stages))]
    out = spread.select("bucket", F.col("__span").alias("span"), "ts", "actor", "us", "stage").groupBy("bucket", "span").transformWithStateInPandas(
        StageTracker(len(stages), limit_seconds), "actor string, " + ", ".join(f"{n} bigint" for n in names), "Append", "EventTime"
    )
    return out.select(F.col("actor").alias(actor), *[F.timestamp_micros(n).alias(n) for n in names])
