"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(value: str | Column) -> Column:
    """A column given by name or by expression; dotted names are taken literally."""
    return F.col(f"`{value}`") if isinstance(value, str) else value


def field(df: DataFrame, name: str, type_: str = "string") -> Column:
    """The (dotted) column of ``df``, or a typed NULL: a missing field and a null field are the same thing."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(type_)


def wildcard(column: str | Column, pattern: str) -> Column:
    """LIKE where ``*`` or ``%`` is any text and ``?`` one character; ``_`` is literal."""
    like = pattern.replace("\\", "\\\\").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return as_col(column).like(like)


def wildcard_any(column: str | Column, patterns: list[str]) -> Column:
    """True where any of the wildcard patterns matches."""
    return any_of([wildcard(column, p) for p in patterns])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def fill(target: Column, *sources: Column) -> Column:
    """First non-null of the target and then its sources; never overwrites a value."""
    return F.coalesce(target, *sources)


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole`` with two decimals; NULL when the whole is zero."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), 2)


def compact_array(*items: Column) -> Column:
    """Distinct non-null items in order, or NULL when none is set."""
    packed = F.array_distinct(F.array_compact(F.array(*items)))
    return F.when(F.size(packed) > 0, packed)


def ipv4_number(ip: Column) -> Column:
    """Dotted IPv4 text as a long; NULL when it is not four octets in range."""
    parts = F.split(ip, r"\.")
    octet = [F.try_element_at(parts, F.lit(i + 1)).try_cast("int") for i in range(4)]
    valid = (F.size(parts) == 4) & all_of([o.between(0, 255) for o in octet])
    number = reduce(lambda acc, o: acc * 256 + o, octet, F.lit(0).cast("long"))
    return F.when(valid, number)


def nest(df: DataFrame) -> DataFrame:
    """Fold dotted column names (``event.kind``) into nested structs, keeping first-seen order."""
    tree: dict = {}
    for name in df.columns:
        node = tree
        *parents, leaf = name.split(".")
        for parent in parents:
            node = node.setdefault(parent, {})
        node[leaf] = name

    def build(node: dict | str) -> Column:
        if isinstance(node, str):
            return F.col(f"`{node}`")
        return F.struct(*[build(child).alias(key) for key, child in node.items()])

    return df.select(*[build(node).alias(key) for key, node in tree.items()])
