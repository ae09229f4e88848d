"""Merged look-ups against brute force, and what their plan reads and shuffles."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from skyledger.functions.merged import PROBES, Latest, Newest, Trailing, fresh, merged_lookups
from skyledger.operators import correlation as c
from skyledger.plans import QUERIES

T0 = dt.datetime(2024, 1, 1)


def at(micros):
    return T0 + dt.timedelta(microseconds=micros)


def hot_rows(n, seed, keys="abc"):
    """Nine rows in ten are of one key in one minute, many at the same instant."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if rng.random() < 0.9:
            out.append((i, "hot", at(rng.choice([rng.randrange(0, 60_000_000), 30_000_000, 30_000_001])), rng.randrange(5)))
        else:
            out.append((i, rng.choice([*keys, None]), None if rng.random() < 0.1 else at(rng.randrange(0, 3 * 86_400_000_000)), rng.randrange(5)))
    return out


SCHEMA = "id long, host string, ts timestamp, v int"


@pytest.mark.parametrize("parts", [1, 13])
def test_all_look_ups_at_once(spark, parts):
    probes, events, assets = hot_rows(150, 1), hot_rows(400, 2), hot_rows(60, 3)
    p, e, a = (spark.createDataFrame(x, SCHEMA).repartition(parts) for x in (probes, events, assets))
    lookups = [
        Latest("last", "events", "host", ("v", "id"), "id", 3600, F.col("v") != 2),
        Trailing("many", "events", "host", 1800),
        Trailing("few", "events", "host", 20, F.col("v") == 1),
        Trailing("all_probes", PROBES, None, 600, F.col("v") > 1),
        Newest("asset", "assets", "host", ("id",), ("ts", "id"), F.col("v") < 4),
    ]
    found = merged_lookups(p, lookups, {"events": e, "assets": a})
    rows = {r["id"]: r for r in p.join(found, "id", "left").withColumn("last", fresh("last", "ts", 3600)).collect()}
    assert len(rows) == len(probes)
    within = lambda x, t, s: x is not None and t is not None and t - dt.timedelta(seconds=s) <= x <= t
    for i, host, t, _ in probes:
        mine = [x for x in events if x[1] == host and host is not None]
        last = max(((x[2], x[0], x[3]) for x in mine if x[3] != 2 and within(x[2], t, 3600)), default=None)
        got = rows[i]["last"]
        assert (got and (got["id"], got["v"])) == (last and (last[1], last[2]))
        assert rows[i]["many"] == sum(within(x[2], t, 1800) for x in mine)
        assert rows[i]["few"] == sum(within(x[2], t, 20) and x[3] == 1 for x in mine)
        assert rows[i]["all_probes"] == sum(within(x[2], t, 600) and x[3] > 1 for x in probes)
        newest = max(((x[2], x[0]) for x in assets if x[1] == host and host is not None and x[2] is not None and x[3] < 4), default=None)
        assert (rows[i]["asset"] and rows[i]["asset"]["id"]) == (newest and newest[1])


def test_a_busy_minute_is_many_groups(spark):
    """The largest group that a window sorts is a second of a key, not the key's minute."""
    from skyledger.functions.merged import SECOND_BITS

    rows = spark.range(120_000).select(F.timestamp_micros(F.col("id") * 500).alias("ts"))
    largest = rows.groupBy(F.shiftright(F.unix_micros("ts"), SECOND_BITS)).count().agg(F.max("count")).first()[0]
    assert largest <= 2100


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "a", at(5), 3)], SCHEMA)
    lookups = [Latest("last", "events", "host", ("v",), "id", 60), Trailing("n", "events", None, 60)]
    assert merged_lookups(none, lookups, {"events": one}).count() == 0
    row = merged_lookups(one, lookups, {"events": none}).first()
    assert (row["last"], row["n"]) == (None, 0)


def test_related_alerts_of_one_busy_instant(spark):
    rows = [(i, at(7), "h", "Attack Discovery" if i % 2 else "Other") for i in range(40)] + [(99, at(7 + 3600 * 10**6), "h", "Other"), (100, at(8 + 3600 * 10**6), "h", "Other")]
    got = {r["id"]: r["related_alert_count"] for r in c.related_alert_count(spark.createDataFrame(rows, "id long, ts timestamp, host string, tag string")).collect()}
    assert got == {**dict.fromkeys(range(40), 20), 99: 20, 100: 0}


def test_enrichment_reads_each_table_once(spark, sf_dir):
    df = QUERIES["j08_enriched_alert"](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hash|range|Single|Round)", plan)
    # Alerts are read as probes and as the rows that the answers are joined to; events, assets, staff and tickets once each.
    assert plan.count("FileScan parquet") <= 6 and len(exchanges) <= 7 and plan.count("ReusedExchange") >= 2
