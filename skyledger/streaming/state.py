"""State processors: alerts with their latest event, newest stage chains, and anomaly baselines, each with bounded state.

A processor buffers a key's rows until the watermark has passed them, so rows may arrive in any order, and takes them in time order from then
on.  What it remembers of passed rows has a fixed size: one event, one chain a stage, the last closed buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyledger.functions.timebucket import micros

LATE = "120 seconds"
US = 1_000_000
#: How long one state key of an entity lives, in seconds.
SPAN = 7 * 86400


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Waiting:
    """A key's rows that the watermark has not passed: one packed block per batch, so that later blocks stay untouched.

    The first column, ``us``, is the rows' time in microseconds.
    """

    def __init__(self, handle: StatefulProcessorHandle, columns: dict[str, str]) -> None:
        self._handle, self._columns = handle, list(columns)
        self._blocks = handle.getMapState("blocks", "first bigint, block bigint", ", ".join(f"{c} array<{t}>" for c, t in columns.items()))
        self._number = handle.getValueState("number", "n bigint")

    def _put(self, rows: pd.DataFrame) -> None:
        number = self._number.get()[0] if self._number.exists() else 0
        first = int(rows["us"].min())
        self._blocks.updateValue((first, number), tuple(rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in self._columns))
        self._number.update((number + 1,))
        self._handle.registerTimer(first // 1000 + 1)

    def add(self, batches: Iterator[pd.DataFrame]) -> None:
        frames = [b[self._columns] for b in batches if len(b)]
        if frames:
            self._put(pd.concat(frames, ignore_index=True))

    def take(self, passed: int) -> pd.DataFrame:
        """Rows up to ``passed``, unsorted; the others wait on."""
        ready = [k for k in self._blocks.keys() if k[0] <= passed]  # noqa: SIM118
        parts = []
        for key in ready:
            values = self._blocks.getValue(key)
            parts.append(pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(self._columns, values, strict=True)}))
            self._blocks.removeKey(key)
        if not parts:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in self._columns})
        rows = pd.concat(parts, ignore_index=True)
        rows["us"] = rows["us"].astype("int64")
        later = rows["us"] > passed
        if later.any():
            self._put(rows[later])
        return rows[~later]


class LatestEvent(StatefulProcessor):
    """For each alert the latest event of its key at or before it; of events that have passed, only the newest is kept."""

    def __init__(self, within_seconds: int) -> None:
        self._within = within_seconds * US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = Waiting(handle, {"us": "bigint", "alert": "boolean", "id": "bigint", "src_ip": "string", "user_name": "string"})
        self._newest = handle.getValueState("newest", "us bigint, id bigint, src_ip string, user_name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._waiting.add(rows)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self._waiting.take(passed)
        asks = rows["alert"].astype(bool)
        alerts, events = rows[asks], rows[~asks].sort_values(["us", "id"])
        known = self._newest.get() if self._newest.exists() else None
        if known is not None and passed - known[0] > self._within + US:
            self._newest.clear()
        if known is not None:
            events = pd.concat([pd.DataFrame([known], columns=["us", "id", "src_ip", "user_name"]), events], ignore_index=True)
        if len(events):
            last = events.iloc[-1]
            if known is None or len(events) > 1:
                self._newest.update((int(last["us"]), int(last["id"]), last["src_ip"], last["user_name"]))
                self._handle.registerTimer((int(last["us"]) + self._within) // 1000 + 1002)
        if len(alerts):
            at = alerts["us"].to_numpy("int64")
            times = events["us"].to_numpy("int64") if len(events) else np.zeros(0, "int64")
            found = np.searchsorted(times, at, "right") - 1
            fresh = (found >= 0) & (at - times[np.maximum(found, 0)] <= self._within) if len(times) else np.zeros(len(at), bool)
            hit = events.iloc[np.maximum(found, 0)].reset_index(drop=True) if len(times) else pd.DataFrame(index=range(len(at)), columns=["us", "id", "src_ip", "user_name"])
            pick = lambda c: hit[c].astype(object).where(fresh, None)
            yield pd.DataFrame({
                "alert_id": alerts["id"].astype("int64").to_numpy(), "alert_us": at, "event_us": pick("us").astype("Int64"),
                "event_id": pick("id").astype("Int64"), "src_ip": pick("src_ip"), "event_user": pick("user_name"),
            })

    def close(self) -> None:
        pass


def alerts_with_latest_event(alerts: DataFrame, events: DataFrame, key: str = "host", within_seconds: int = 3600, late: str = LATE) -> DataFrame:
    """One row per alert that the watermark has passed: the latest event of its entity in the time before it, by (ts, id); NULLs without one.

    Both streams are read once and meet in one state operator.  Its key is the entity and a span of time; an event at the end of a span goes
    to the next one as well, so a busy entity's spans are worked on side by side and old ones cost nothing.  Rows without an entity match nothing.
    """
    use_rocksdb(alerts.sparkSession)
    span = lambda ts, plus=0: F.floor((micros(ts) + plus * US) / (SPAN * US))
    a = alerts.withWatermark("ts", late).select(F.col(key).alias("entity"), "ts", F.array(span("ts")).alias("spans"), F.lit(True).alias("alert"), F.col("id").cast("long").alias("id"), *(F.lit(None).cast("string").alias(c) for c in ("src_ip", "user_name")))
    e = events.where(F.col(key).isNotNull()).withWatermark("ts", late)
    e = e.select(F.col(key).alias("entity"), "ts", F.array_distinct(F.array(span("ts"), span("ts", within_seconds))).alias("spans"), F.lit(False).alias("alert"), F.col("id").cast("long").alias("id"), "src_ip", "user_name")
    rows = a.unionByName(e).withColumn("span", F.explode("spans")).select("entity", "span", "ts", micros("ts").alias("us"), "alert", "id", "src_ip", "user_name")
    schema = "alert_id bigint, alert_us bigint, event_us bigint, event_id bigint, src_ip string, event_user string"
    out = rows.groupBy("entity", "span").transformWithStateInPandas(LatestEvent(within_seconds), schema, "Append", "EventTime")
    return out.select("alert_id", F.timestamp_micros("alert_us").alias("alert_ts"), F.timestamp_micros("event_us").alias("event_ts"), "event_id", "src_ip", "event_user")


def advance_newest(chains: list[list[int]], us: np.ndarray, stage: np.ndarray, limit: int) -> list[list[int]]:
    """Feed passed events to the newest chain of every stage and return the chains that they complete.

    ``chains[k]`` has k stages or is empty.  Of all chains that wait for the same stage only the one with the newest start can give the
    tightest chain, since whatever comes next advances them all.  Later stages of one instant go first, so each stage is strictly
    after the one before.  Of neighbouring events of one stage only the newest start, or else the first, matters.
    """
    order = np.lexsort((-stage, us))
    us, stage = us[order], stage[order]
    if len(us):
        change = stage[1:] != stage[:-1]
        keep = np.where(stage == 0, np.append(change, True), np.concatenate([[True], change]))
        us, stage = us[keep], stage[keep]
    out, last = [], len(chains)
    for at, k in zip(us.tolist(), stage.tolist(), strict=True):
        if k == 0:
            chains[1] = [at]
        elif chains[k] and chains[k][-1] < at:
            chain, chains[k] = [*chains[k], at], []
            if at - chain[0] <= limit:
                if k + 1 == last:
                    out.append(chain)
                else:
                    chains[k + 1] = chain
    return out


class NewestChains(StatefulProcessor):
    """The newest open chain of each stage per actor, whatever the number of events."""

    def __init__(self, stages: int, limit_seconds: int) -> None:
        self._stages, self._limit = stages, limit_seconds * US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = Waiting(handle, {"us": "bigint", "stage": "int"})
        self._chains = handle.getValueState("chains", "times array<array<bigint>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._waiting.add(rows)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self._waiting.take(passed)
        chains = [[int(t) for t in c] for c in self._chains.get()[0]] if self._chains.exists() else [[] for _ in range(self._stages)]
        out = advance_newest(chains, rows["us"].to_numpy("int64"), rows["stage"].to_numpy("int64"), self._limit)
        chains = [c if c and passed - c[0] <= self._limit else [] for c in chains]
        if any(chains):
            self._chains.update((chains,))
            self._handle.registerTimer((min(c[0] for c in chains if c) + self._limit) // 1000 + 2)
        else:
            self._chains.clear()
        if out:
            yield pd.DataFrame({"actor": [key[0]] * len(out), **{f"t{i + 1}": [c[i] for c in out] for i in range(self._stages)}})

    def close(self) -> None:
        pass


def newest_chains(events: DataFrame, actor: str, stages: tuple[str, ...], limit_seconds: int, late: str = LATE) -> DataFrame:
    """For each completed ordered chain its tightest form: the newest start that the last stage completes, with the time of each stage.

    State per actor is one open chain a stage and the rows that the watermark has not passed.
    """
    use_rocksdb(events.sparkSession)
    stage = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("action")).cast("int") - 1
    rows = events.withWatermark("ts", late).where(F.col("action").isin(*stages) & F.col(actor).isNotNull())
    rows = rows.select(F.col(actor).alias("actor"), "ts", micros("ts").alias("us"), stage.alias("stage"))
    names = [f"t{i + 1}" for i in range(len(stages))]
    out = rows.groupBy("actor").transformWithStateInPandas(NewestChains(len(stages), limit_seconds), "actor string, " + ", ".join(f"{n} bigint" for n in names), "Append", "EventTime")
    return out.select(F.col("actor").alias(actor), *[F.timestamp_micros(n).alias(n) for n in names])


def score_next(recent: np.ndarray, x: float, minimum: int, eps: float) -> float:
    """Score of a bucket against those before it, as ``anomalies.score`` defines it; 0 without enough of them.  NaN stands for no value."""
    seen = recent[~np.isnan(recent)]
    if np.isnan(x) or len(seen) < minimum:
        return 0.0
    z = (x - seen.mean()) / max(seen.std(ddof=1) if len(seen) > 1 else 0.0, eps)
    return round(100 * (1 - float(np.exp(-max(z - 2, 0.0) / 3))), 3)


class Baseline(StatefulProcessor):
    """The last closed buckets of a key; each bucket is scored as it closes."""

    def __init__(self, keys: list[str], history: int, minimum: int, eps: float) -> None:
        self._keys, self._history, self._minimum, self._eps = keys, history, minimum, eps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._recent = handle.getValueState("recent", "x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = pd.concat(list(rows), ignore_index=True).sort_values("bucket")
        recent = np.array(self._recent.get()[0], float) if self._recent.exists() else np.zeros(0)
        # Buckets close in time order from batch to batch, since all of a batch end after the watermark of the one before.
        all_x = np.concatenate([recent, closed["x"].to_numpy(float)])
        scores = [score_next(all_x[max(0, i - self._history) : i], all_x[i], self._minimum, self._eps) for i in range(len(recent), len(all_x))]
        self._recent.update((all_x[-self._history :].tolist(),))
        out = closed[["bucket", *self._keys]].assign(actual=closed["x"].astype(float), anomaly_score=scores)
        yield out[out["anomaly_score"] > 0]

    def close(self) -> None:
        pass


def score_closed_buckets(buckets: DataFrame, by: list[str], value: str, history: int = 24, minimum: int = 8, eps: float = 1e-9) -> DataFrame:
    """``bucket``, keys, ``actual`` and ``anomaly_score`` of buckets above their baseline, for a stream of closed buckets in append mode.

    State per key is its last ``history`` values; no closed bucket is read again.  The result equals the batch score of the whole table.
    """
    use_rocksdb(buckets.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in buckets.schema.fields}
    rows = buckets.select("bucket", *by, F.col(value).cast("double").alias("x"))
    schema = ", ".join(["bucket timestamp", *(f"`{c}` {kinds[c]}" for c in by), "actual double", "anomaly_score double"])
    return rows.groupBy(*by).transformWithStateInPandas(Baseline(by, history, minimum, eps), schema, "Append", "None")
