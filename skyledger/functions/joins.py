"""Joins with dimensions whose size is checked before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
#: Text bytes of the rows; in memory they take a few times as many.
MAX_BROADCAST_BYTES = 32 << 20


def checked_broadcast(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark a dimension for broadcast only when a bounded look proves it small in rows and bytes; otherwise leave the join to shuffle."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dim.columns])))
    seen = dim.limit(max_rows + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(dim) if seen["rows"] <= max_rows and seen["bytes"] <= max_bytes else dim


def lookup_map(mapping: dict[str, str], key: Column) -> Column:
    """Value of a constant map from code, NULL when the key is absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: str, salts: int = 16) -> DataFrame:
    """Left join whose hot keys are split: left rows get a salt from ``spread_by``, right rows are copied per salt.

    For a right side with one row per key.
    """
    salt = F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salts))
    spread = left.withColumn("__salt", salt)
    copies = right.withColumn("__salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return spread.join(copies, [*keys, "__salt"], "left").drop("__salt")
