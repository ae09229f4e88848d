"""Several time-ordered look-ups per row in one merge: latest match, trailing counts and newest row, whatever tables they come from.

Probe rows and the rows of all tables become typed rows on one time line per key.  They are shuffled once, by key and second; a window over each
second answers what that second knows.  What earlier seconds know travels in totals of one row per second, summed up in two steps (seconds of a
longer chunk, then chunks of a key), so the largest group of any step is one second of one key, or 65,536 totals, or a key's
chunks of 19 hours, however rows are spread over keys and time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import any_of
from skyledger.functions.timebucket import micros

#: Time is cut at so many bits of microseconds: about a second, and 65,536 of those.
SECOND_BITS, CHUNK_BITS = 20, 16
#: The scope of look-ups over all rows.
ALL = "*"
NOW = 0
_NO_TIME = -(1 << 60)


@dataclass(frozen=True)
class Latest:
    """The newest row of a table with the probe's key at or before its time, at most ``seconds`` older; ties by ``tie``."""

    name: str
    table: str
    key: str
    values: tuple[str, ...]
    tie: str
    seconds: int
    where: Column | None = None


@dataclass(frozen=True)
class Trailing:
    """How many rows of a table lie in the closed interval of ``seconds`` up to the probe; over all rows without a key."""

    name: str
    table: str
    key: str | None
    seconds: int
    where: Column | None = None


@dataclass(frozen=True)
class Newest:
    """The newest row of a table with the probe's key by ``order``, whatever its time."""

    name: str
    table: str
    key: str
    values: tuple[str, ...]
    order: tuple[str, ...]
    where: Column | None = None


Lookup = Latest | Trailing | Newest
#: The probe rows themselves as a table.
PROBES = "probes"


def _scope(x: Lookup) -> str:
    return x.key or ALL


def _combined(x: Lookup, column: str) -> Column:
    """Values of several rows as one: a count is a sum, the newest of structs that begin with their time is the greatest."""
    return F.sum(column) if isinstance(x, Trailing) else F.max(column)


def _value(x: Lookup, ts: str) -> Column:
    """What a row of the look-up's table is worth to it, NULL if nothing."""
    if isinstance(x, Trailing):
        value: Column = F.lit(1).cast("long")
    elif isinstance(x, Latest):
        value = F.struct(micros(ts).alias("__at"), F.col(x.tie).alias("__tie"), *x.values)
    else:
        value = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(x.order)], *x.values)
    return value if x.where is None else F.when(x.where, value)


def _typed(df: DataFrame, name: str, lookups: list[Lookup], kinds: list, id_kind, row_id: str, ts: str) -> DataFrame:
    """Typed rows of one table, which is read once: ``scope, key, second``, never NULL, and ``us, role, id`` and a value per look-up."""
    us, empty = micros(ts), [F.lit(None).cast(k) for k in kinds]
    values = [_value(x, ts) if x.table == name else empty[i] for i, x in enumerate(lookups)]

    def row(scope: str, at: Column, role: int | None, row_values: list[Column]) -> Column:
        key = F.lit(ALL) if scope == ALL else F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit(""))
        second = F.coalesce(F.shiftright(at, SECOND_BITS), F.lit(_NO_TIME))
        identity = F.lit(None).cast(id_kind) if role is None else F.col(row_id)
        held = [v.cast(k).alias(f"v{i}") for i, (v, k) in enumerate(zip(row_values, kinds, strict=True))]
        return F.struct(F.lit(scope).alias("scope"), key.alias("key"), second.alias("second"), at.alias("us"), F.lit(role).cast("int").alias("role"), identity.alias("id"), *held)

    rows = []
    for scope in dict.fromkeys(map(_scope, lookups)):
        wanted = [i for i, x in enumerate(lookups) if x.table == name and _scope(x) == scope]
        if wanted:
            held = any_of([values[i].isNotNull() for i in wanted]) & us.isNotNull()
            known = held if scope == ALL else held & F.col(scope).isNotNull()
            rows.append(F.when(known, row(scope, us, None, [values[i] if i in wanted else empty[i] for i in range(len(lookups))])))
        if name == PROBES:
            back = dict.fromkeys(x.seconds for x in lookups if isinstance(x, Trailing) and _scope(x) == scope)
            rows.append(row(scope, us, NOW, empty))
            rows += [row(scope, us - (s * 1_000_000 + 1), s, empty) for s in back]
    return df.select(F.explode(F.array_compact(F.array(*rows))).alias("t")).select("t.*")


def merged_lookups(probes: DataFrame, lookups: list[Lookup], tables: dict[str, DataFrame], row_id: str = "id", ts: str = "ts") -> DataFrame:
    """``row_id`` and one column per look-up: a struct of the values (and ``__at``, the time of a ``Latest``), NULL without a match, or a count.

    ``row_id`` is unique in ``probes``; ``ts`` is the time in all tables.  Keys have the same name everywhere and are compared as text; rows
    without a key or a time match nothing.  Every table is read once: a row serves all look-ups of its table and key.
    """
    numbered = list(enumerate(lookups))
    tables = {**tables, PROBES: probes}
    kinds = [tables[x.table].select(_value(x, ts).alias("v")).schema[0].dataType for x in lookups]
    names = dict.fromkeys([PROBES, *(x.table for x in lookups)])
    typed = reduce(DataFrame.unionByName, [_typed(tables[n], n, lookups, kinds, probes.schema[row_id].dataType, row_id, ts) for n in names])
    place = ["scope", "key"]
    typed = typed.repartition(*place, "second")

    # Rows of tables have no role and come before probes of the same instant.
    inner = Window.partitionBy(*place, "second").orderBy("us", F.asc_nulls_first("role")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = typed.select(*place, "second", "id", "role", *[_combined(x, f"v{i}").over(inner).alias(f"in{i}") for i, x in numbered]).where("role IS NOT NULL")

    # Both uses of the shuffled rows ask for the same columns, so they share one shuffle: the counts are never negative.
    asked = [F.count(c).alias(f"n_{c}") for c in ("us", "role", "id")]
    totals = typed.groupBy(*place, "second").agg(*[_combined(x, f"v{i}").alias(f"v{i}") for i, x in numbered], *asked).where("n_us + n_role + n_id >= 0")
    seconds = totals.select(*place, F.shiftright("second", CHUNK_BITS).alias("chunk"), "second", *[f"v{i}" for i, _ in numbered]).repartition(*place, "chunk")
    by_second = Window.partitionBy(*place, "chunk").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    carried = seconds.select(*place, "chunk", "second", *[_combined(x, f"v{i}").over(by_second).alias(f"s{i}") for i, x in numbered])

    chunks = seconds.groupBy(*place, "chunk").agg(*[_combined(x, f"v{i}").alias(f"v{i}") for i, x in numbered], F.count("second").alias("n")).where("n >= 0")
    whole = Window.partitionBy(*place)
    by_chunk = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    older = chunks.select(*place, "chunk", *[_combined(x, f"v{i}").over(whole if isinstance(x, Newest) else by_chunk).alias(f"c{i}") for i, x in numbered])
    known = carried.join(older, [*place, "chunk"]).drop("chunk")

    answered = inside.join(known, [*place, "second"], "left")
    aggs = []
    for i, x in numbered:
        here = F.col("scope") == _scope(x)
        if isinstance(x, Trailing):
            count = reduce(Column.__add__, [F.coalesce(f"{c}{i}", F.lit(0)) for c in ("in", "s", "c")])
            sign = F.when(F.col("role") == NOW, 1).when(F.col("role") == x.seconds, -1).otherwise(0)
            aggs.append(F.sum(F.when(here, sign * count)).alias(f"v{i}"))
        else:
            found = F.greatest(f"in{i}", f"s{i}", f"c{i}")
            aggs.append(F.max(F.when(here & (F.col("role") == NOW), found)).alias(f"v{i}"))
    per_row = answered.groupBy(F.col("id").alias(row_id)).agg(*aggs)
    return per_row.select(row_id, *[F.col(f"v{i}").alias(x.name) for i, x in numbered])


def fresh(match: str, ts: str, seconds: int) -> Column:
    """A ``Latest`` match if it is not older than the look-up allows."""
    return F.when(F.col(f"{match}.__at") >= micros(ts) - seconds * 1_000_000, F.col(match))
